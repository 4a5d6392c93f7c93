"""Operators that no SQL expresses, each against a plain version on a small store."""

import math
import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import stems
from recallgrid.operators import packs, retrieval, vectors, walk
from recallgrid.operators.graph import LAPLACIAN, WALK
from recallgrid.sources.model import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    return load(spark, SF_DIR)


@pytest.fixture(scope="module")
def dense(spark, store):
    """The same beliefs with many edges among few of them, so that budgets bind."""
    rng = random.Random(5)
    kinds = [*WALK, "POTENTIALLY_STALE"]
    rows = {(f"d{rng.randrange(40)}", f"d{rng.randrange(60)}", rng.choice(kinds)) for _ in range(1500)}
    edges = spark.createDataFrame([(a, b, t, round(rng.random(), 2), "") for a, b, t in sorted(rows)], "src string, dst string, type string, weight double, anchor_text string")
    return store.replaced(edges=edges)


def plain_walk(store, seed, depth=2, per_node=16, total=32, least=0.1):
    active = {r.id for r in store.active.select("id").collect()}
    out = {}
    for e in store.edges.collect():
        a, b = (e.dst, e.src) if e.type == "SUPERSEDES" else (e.src, e.dst)
        out.setdefault(a, []).append((-WALK.get(e.type, 0.0), -e.weight, b, e.type))
    visited, front, hops = {seed}, [(seed, 1.0, [seed])], []
    for hop in range(1, depth + 1):
        following = []
        for node, score, trail in front:
            seen, ranked = set(), []
            for w, _, to, kind in sorted(x for x in out.get(node, []) if x[2] not in visited):
                if to not in seen and len(ranked) < per_node:
                    seen.add(to)
                    ranked.append((to, -w, kind))
            for to, w, kind in ranked:
                if len(hops) >= total or w == 0 or score * w < least:
                    continue
                visited.add(to)
                if to in active:
                    hops.append((to, round(score * w, 6), hop, (*trail, to)))
                    following.append((to, score * w, [*trail, to]))
        front = following
    return hops


def test_greedy_expansion(spark, dense):
    seeds = [f"d{i}" for i in range(40)]
    active = {r.id for r in dense.active.select("id").collect()}
    got = {}
    for r in walk.expand(dense, spark.createDataFrame([(s,) for s in seeds if s in active], "seed string")).collect():
        got.setdefault(r.seed, []).append((r.node, round(r.score, 6), r.depth, tuple(r.trail)))
    full = 0
    for s in seeds:
        if s in active:
            want = plain_walk(dense, s)
            full += len(want) == 32
            assert sorted(got.get(s, [])) == sorted(want), s
    assert full > 3  # budgets bind


def test_cluster_pack(spark):
    rng = random.Random(3)
    rows = [(q, f"b{q}-{c}-{m}", c, m, rng.randrange(5, 60)) for q in range(6) for c in range(5) for m in range(rng.randrange(1, 5))]
    got = {}
    df = spark.createDataFrame(rows, "query_id int, id string, cluster int, member int, tokens int")
    for r in packs.pack_clusters(df, 150).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id))
    for q in range(6):
        mine = sorted((c, m, i, t) for qq, i, c, m, t in rows if qq == q)
        taken, used = [], 0
        for c, m, i, t in [x for x in mine if x[1] == 0][:3]:
            if used + t > 150:
                break
            taken, used = [*taken, i], used + t
        for c, m, i, t in mine:
            if i not in taken and used + t <= 150:
                taken, used = [*taken, i], used + t
        assert [i for _, i in sorted(got[q])] == taken


def test_coverage_pack_beats_any_single(spark):
    rng = random.Random(9)
    terms = {f"t{k}": 1.0 + k for k in range(12)}
    rows = [(q, f"b{k:02d}", float(rng.randrange(9)), rng.randrange(10, 50), rng.sample(sorted(terms), rng.randrange(1, 6)), terms) for q in range(5) for k in range(15)]
    df = spark.createDataFrame(rows, "query_id int, id string, score double, tokens int, covers array<string>, weights map<string,double>")
    got = packs.pack_coverage(df, 90).toPandas()
    for q, g in got.groupby("query_id"):
        mine = {r[1]: r for r in rows if r[0] == q}
        assert sum(mine[i][3] for i in g.id) <= 90
        value = sum(terms[t] for t in {t for i in g.id for t in mine[i][4]})
        assert value >= max(sum(terms[t] for t in r[4]) for r in mine.values() if r[3] <= 90)
        ranks = [(-mine[i][2], i) for i in g.id]
        assert ranks == sorted(ranks)


def test_draws_are_fair_and_repeat(spark):
    ids = [f"x{k}" for k in range(7)]
    assert packs.drawn(ids, 42, 3) == packs.drawn(list(reversed(ids)), 42, 3) and len(set(packs.drawn(ids, 42, 9))) == 7
    first = [packs.drawn(ids, s, 1)[0] for s in range(7000)]
    assert all(850 < first.count(i) < 1150 for i in ids)
    seed = spark.range(1).select(packs.seed_of(F.lit("s"), F.lit(20), F.lit("q")).alias("s")).first().s
    assert int(seed) == int.from_bytes(__import__("hashlib").blake2b(b"s\x1f20\x1fq", digest_size=8).digest(), "big")


def test_heat_equals_eigenvectors(spark, store):
    ids = sorted({x for e in store.edges.collect() for x in (e.src, e.dst)})
    at = {i: k for k, i in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for e in store.edges.collect():
        v = LAPLACIAN.get(e.type, 0.0) * e.weight
        if v and e.src != e.dst:
            w[at[e.src], at[e.dst]] += v
            w[at[e.dst], at[e.src]] += v
    d = np.abs(w).sum(1)
    half = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    values, basis = np.linalg.eigh(np.eye(len(ids)) - half[:, None] * np.round(w, 12) * half[None, :])
    seeds = {ids[3]: 0.6, ids[50]: 0.4}
    s = np.zeros(len(ids))
    for i, x in seeds.items():
        s[at[i]] = x
    want = basis @ (np.exp(-3.0 * values) * (basis.T @ s))
    rows = vectors.heat(store, spark.createDataFrame([("q", i, x) for i, x in seeds.items()], "query_id string, i string, s double"), 3.0).collect()
    got = np.zeros(len(ids))
    for r in rows:
        got[at[r.i]] = r.s
    assert np.abs(got - want).max() < 1e-5


def test_bound_vectors_come_apart():
    a, b, c = (vectors.vector_of(n) for n in "abc")
    made = vectors.bind(a, b)
    back = vectors.unbind(a, made)
    cosine = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert cosine(back, b) > 0.6 and abs(cosine(back, c)) < 0.2
    assert np.allclose(made, vectors.bind(b, a)) and math.isclose(np.linalg.norm(a), 1, abs_tol=0.2)


#: Words and their stems from the paper that describes the algorithm.
STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_stems_and_folds():
    assert [stems.porter(w) for w in STEMS[::2]] == STEMS[1::2]
    assert stems.porter("is") == "is" and stems.porter("x" * 80 + "ing") == "x" * 80 + "ing"
    assert stems.folded("Café naïve Á ø ß") == "Cafe naive A ø ß"


def test_stemmed_search(spark, store):
    docs = [("a", "Relational tables relate to rows"), ("b", "the cats sat; a cat sits"), ("c", "Dogs and CATS"), ("d", ""), ("e", None)]
    anchors = [("x", "c", "rows of cats"), ("x", "zz", "cats"), ("y", "d", "")]
    df = spark.createDataFrame(docs, "id string, content string")
    links = spark.createDataFrame(anchors, "src string, dst string, anchor_text string")
    index = retrieval.Index(df, anchors=links, stem=True)
    asked = spark.createDataFrame([("q1", "cats row"), ("q2", "relate"), ("q3", "nothing")], "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in index.match(asked).collect()}

    def words(t):
        return [stems.porter(stems.folded(w)) for w in __import__("re").findall(r"\w+", (t or "").lower())]

    texts = {i: words(t) + 3 * [w for _, d, a in anchors if d == i for w in words(a)] for i, t in docs}
    n, avg = len(docs), sum(map(len, texts.values())) / len(docs)
    want = {}
    for q, query in (("q1", "cats row"), ("q2", "relate"), ("q3", "nothing")):
        for w in words(query):
            df_w = sum(w in t for t in texts.values())
            for i, t in texts.items():
                if w in t:
                    idf = math.log(1 + (n - df_w + 0.5) / (df_w + 0.5))
                    want[q, i] = want.get((q, i), 0) + idf * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("segments", [8, 2])
def test_updates_of_updates(spark, segments, monkeypatch):
    """Texts that come, go, change and change back, with anchors; many small segments, and some that are merged."""
    monkeypatch.setattr(retrieval, "MOST_SEGMENTS", segments)
    rng = random.Random(segments)

    def text():
        return rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 9)))

    now = {f"d{k}": text() for k in range(40)}
    links = [("x", f"d{k}", "eps anchor") for k in range(0, 40, 3)]
    index, old = None, dict(now)
    for step in range(4):
        docs = spark.createDataFrame(list(now.items()), "id string, content string").repartition(3)
        anchors = spark.createDataFrame(links, "src string, dst string, anchor_text string")
        index = retrieval.Index(docs, anchors=anchors).written() if index is None else index.updated(docs, anchors=anchors)
        fresh = retrieval.Index(docs, anchors=anchors)
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert rows(index.postings) == rows(fresh.postings) and rows(index.frequencies) == rows(fresh.frequencies) and rows(index.totals) == rows(fresh.totals)
        asked = spark.createDataFrame([("q", "alpha eps anchor"), ("r", "zeta"), ("s", "none")], "query_id string, query string")
        assert rows(retrieval.top(index.match(asked), 50)) == rows(retrieval.top(fresh.match(asked), 50))
        for k in rng.sample(sorted(now), 8):
            now[k] = old.get(k) if rng.random() < 0.4 else text()
        del now[rng.choice(sorted(now))]
        now[f"n{step}"] = text()
        links = links[1:] + [("y", f"n{step}", "gamma")]
    assert len(index.segments) <= segments


def test_buckets_of_terms(spark):
    terms = ["alpha", "é", "文字", "", "x" * 70]
    got = {r.term: r.b for r in spark.createDataFrame([(t,) for t in terms], "term string").selectExpr("term", "pmod(xxhash64(term), 37) AS b").collect()}
    assert got == {t: retrieval._in_bucket(t, 37) for t in terms}


def test_an_updated_index_is_the_new_one(spark):
    rng = random.Random(1)

    def text():
        return " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(0, 9)))

    old = [(f"d{k}", text()) for k in range(60)]
    new = [(i, text() if k % 5 == 0 else t) for k, (i, t) in enumerate(old[4:])] + [("n1", "zeta alpha")]
    links = spark.createDataFrame([("d1", "d7", "eps eps"), ("d2", "n1", "beta")], "src string, dst string, anchor_text string")
    docs = [spark.createDataFrame(x, "id string, content string") for x in (old, new)]
    updated = retrieval.Index(docs[0], anchors=links.where("dst = 'd7'")).written().updated(docs[1], anchors=links)
    fresh = retrieval.Index(docs[1], anchors=links)
    rows = lambda df: sorted(map(tuple, df.collect()))
    columns = fresh.postings.columns
    assert rows(updated.postings.select(columns)) == rows(fresh.postings) and rows(updated.frequencies) == rows(fresh.frequencies) and rows(updated.totals) == rows(fresh.totals)


def test_entities_yield_to_earlier_patterns():
    from recallgrid.functions.extract import find_entities

    got = [(e["kind"], e["raw"]) for e in find_entities("See src/app/main.py at https://x.org/a, v1.2.3 fails with ValueError on feat/new-lane in my_var")]
    assert ("file_path", "src/app/main.py") in got and ("url", "https://x.org/a,") in got and ("version", "v1.2.3") in got
    assert ("error_code", "ValueError") in got and ("branch", "feat/new-lane") in got and ("identifier", "my_var") in got
    spans = sorted((e["start"], e["end"]) for e in find_entities("the quick brown fox jumps over a lazy dog named foo.bar today"))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert find_entities("") == [] and len(find_entities("a1 2 b 3 c 4 d", 2)) == 2


def test_triples():
    from recallgrid.functions.extract import find_triples

    t = find_triples("The cache is supported by the disk layer. New index supersedes old index.")
    assert {"subject": "the disk layer", "relation": "SUPPORTS", "object": "The cache"}.items() <= t[0].items()
    assert any(x["relation"] == "SUPERSEDES" and x["subject"] == "New index" for x in t)
    assert find_triples("nothing here") == []


def test_docstrings_and_exports(spark, store):
    import json

    from recallgrid.sources import files

    code = spark.createDataFrame([("class A:\n    '''Of A.'''\n    def f(self):\n        'Of f.'\n",), ("not python (",), (None,)], "c string")
    got = [{d["name"]: d["text"] for d in r[0]} for r in code.select(files.docstrings(F.col("c"))).collect()]
    assert got == [{"A": "Of A.", "f": "Of f."}, {}, {}]
    nodes = spark.createDataFrame([("d1", 'say "hi"\n twice', 0.9, "none"), ("d2", "x" * 200, 0.1, "user")], "id string, content string, mean double, lock_level string")
    edges = spark.createDataFrame([("d1", "d2", "CITES"), ("d1", "d9", "CITES")], "src string, dst string, type string")
    objects = [json.loads(r.json) for r in files.graph_json(nodes, edges).collect()]
    assert {"src": "d1", "dst": "d2", "type": "CITES"} in objects and len(objects) == 3
    assert next(o for o in objects if o.get("id") == "d2")["label"] == "x" * 79 + "…"


def test_documents_and_transcripts_of_a_folder(spark, tmp_path):
    from recallgrid.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("A first paragraph that is long enough.\n\nshort\n\n```\ncode that is long enough to be one\n```\n\nA second one, which is long enough too.")
    (tmp_path / "sub" / "b.txt").write_text("Another paragraph in another folder.")
    (tmp_path / "c.py").write_text("x = 'not a document, but long enough to be one'")
    (tmp_path / "t.jsonl").write_text('{"role": "user", "text": "hello", "session_id": "", "ts": "1"}\nbroken\n{"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]}, "sessionId": "s"}\n')
    got = {(r.path.rsplit("/", 1)[-1], r.n, r.paragraph) for r in files.document_paragraphs(spark, str(tmp_path)).collect()}
    assert got == {("a.md", 0, "A first paragraph that is long enough."), ("a.md", 1, "A second one, which is long enough too."), ("b.txt", 0, "Another paragraph in another folder.")}
    turns = {(r.role, r.text, r.session_id, r.ts) for r in files.transcripts(spark, str(tmp_path)).collect()}
    assert turns == {("user", "hello", None, "1"), ("assistant", "a\nb", "s", None)}


def test_capped_pairs(spark):
    from recallgrid.operators.reports import capped_pairs

    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample([f"n{k:02d}" for k in range(30)], 2))) for _ in range(160)})
    used, want = {}, []
    for a, b in pairs:
        if max(used.get(a, 0), used.get(b, 0)) < 3:
            want.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    got = capped_pairs(spark.createDataFrame(pairs, "a string, b string"), 3).collect()
    assert sorted(map(tuple, got)) == want and len(want) < len(pairs)


def test_large_batches_score_alike(spark, monkeypatch):
    """Weights made on the driver, joined with listed terms, and joined with all terms give the same scores."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(f"d{k}", " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(0, 12)))) for k in range(80)], "id string, content string")
    links = spark.createDataFrame([("x", f"d{k}", "beta anchor") for k in range(0, 80, 7)], "src string, dst string, anchor_text string")
    asked = spark.createDataFrame([("q", "alpha beta alpha"), ("r", "anchor nothing"), ("s", "")], "query_id string, query string")
    index = retrieval.Index(docs, anchors=links).written()
    found = []
    for pairs, terms in ((20_000, 2000), (0, 2000), (0, 1)):
        monkeypatch.setattr(retrieval, "LISTED_PAIRS", pairs)
        monkeypatch.setattr(retrieval, "LISTED_TERMS", terms)
        for per_field in (False, True):
            found.append({(r.query_id, r.id): round(r.score, 9) for r in index.match(asked, per_field).collect()})
    assert found[0] and found[0] == found[2] == found[4] and found[1] == found[3] == found[5] and found[0] != found[1]


def test_word_edges_are_those_of_ascii_words(spark):
    """As in RE2: a letter beyond ASCII is no part of a word."""
    from recallgrid.functions import detect

    rows = spark.createDataFrame([("useé it",), ("noé",), ("not usé",), ("never",), ("nó",)], "text string")
    t = F.col("text")
    got = {r.text: r for r in rows.select("text", F.array_join(detect.correction_signals(t), " ").alias("signals"), detect.sentiment(t)["pattern"].alias("pattern"), detect.is_directive(t).alias("directive")).collect()}
    assert got["useé it"].signals == "imperative" and got["noé"].pattern == "no" and got["nó"].pattern is None
    assert got["never"].directive and got["not usé"].signals == "negation"


def test_edit_distance_is_the_tables_and_costs_little(spark):
    """Against the plain table; two texts of 3,000 characters took 9 million cells before."""
    import time

    from recallgrid.operators import similarity

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("abé🎈") for _ in range(n))
    for _ in range(500):
        a, b = draw(rng.randrange(20)), draw(rng.randrange(20))
        assert similarity.edit_distance(a, b) == plain(a, b)
    a, b = draw(3000), draw(3000)
    begun = time.process_time()
    similarity.edit_distance(a, b)
    assert time.process_time() - begun < 0.5
    rows = [("g", i, t) for i, t in enumerate(["abc", "abd", "xbd", None, "abc"])] + [("h", 9, "alone"), ("d", 1, "ab"), ("d", 1, "abc")]
    got = {r.g: (r.medoid, r.distance) for r in similarity.medoids(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t").collect()}
    assert got["h"] == (9, 0) and got["d"] == (1, 2)


def test_equal_queries_are_searched_once(spark):
    """Each gets the rows of its own search; the matches are made for distinct texts only."""
    from recallgrid.operators import retrieval

    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red hen"), ("c", "blue fox")], "id string, content string")
    index = retrieval.Index(docs).written()
    queries = spark.createDataFrame([("1", "red"), ("2", "fox red"), ("3", "red"), ("4", "red"), ("5", None), ("6", "owl")], "query_id string, query string")
    asked, match = [], index.match
    index.match = lambda q: (asked.append(q.count()), match(q))[1]
    got = {tuple(r) for r in retrieval.top_of(index, queries, 2).select("query_id", "id", "score", "place").collect()}
    assert asked == [4]
    assert got and got == {tuple(r) for r in retrieval.top(match(queries), 2).select("query_id", "id", "score", "place").collect()}


def test_a_text_is_counted_within_its_row(spark):
    """Words of texts and of their anchors, with stems and without; nothing is moved to count them, but anchors to their texts."""
    docs = [("a", "Cats sit, a cat sits; cats"), ("b", "Größe x_1 größe 文字"), ("c", ""), ("d", None), ("e", "...")]
    links = [("a", "cat rows"), ("a", "rows dogs"), ("c", "only said"), ("zz", "nothing"), ("e", "---")]
    df = spark.createDataFrame(docs, "id string, content string")
    said = spark.createDataFrame(links, "dst string, anchor_text string")
    words = lambda t: __import__("re").findall(r"\w+", (t or "").lower())
    for anchors, stem in ((None, False), (None, True), (said, False), (said, True)):
        cut = (lambda t: [stems.porter(stems.folded(w)) for w in words(t)]) if stem else words  # noqa: B023
        want = set()
        for i, t in docs:
            own, more = cut(t), [w for d, a in links if anchors is not None and d == i for w in cut(a)]
            want |= {(w, i, own.count(w), more.count(w), len(own), len(more)) for w in own + more}
        rows = retrieval.Index(df, anchors=anchors, stem=stem).postings
        assert sorted(map(tuple, rows.collect())) == sorted(want)
        if anchors is None:
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "Join" not in plan
