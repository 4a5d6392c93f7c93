"""Operators over extracted entities against plain sets."""

import math
import re
from collections import Counter, defaultdict

from recallgrid.functions import extract
from recallgrid.functions.extract import find_entities
from recallgrid.plans import catalog
from recallgrid.sources.model import load

SF = "/root/testdata/sf0.001"


def test_operators_over_extracted_entities(spark):
    store = load(spark, SF)
    beliefs = {r.id: r for r in store.beliefs.collect()}
    active = {i for i, r in beliefs.items() if r.valid_to is None}
    own = {i: find_entities(r.content or "") for i, r in beliefs.items()}
    turns = {r.conv_id * 100 + r.turn: find_entities(r.text or "") for r in store.turns.collect() if (r.conv_id * 100 + r.turn) % 20 == 0}
    sets = {i: {e["lower"] for e in found} for i, found in own.items()}
    fan = Counter(e for i in active for e in sets[i])

    def best(weight):
        out = {}
        for q, found in turns.items():
            wanted = {e["lower"] for e in found}
            scored = [(round(sum(weight(e) for e in sorted(wanted & sets[i])), 6), i) for i in active if wanted & sets[i]]
            for n, (score, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:20], 1):
                out[q, i] = n, score
        return out

    for name, weight in (("extracted_overlap", lambda e: 1), ("extracted_fan_effect", lambda e: math.log(len(active) + 1) - math.log(fan[e] + 1))):
        got = {(r.query_id, r.belief_id): (r.place, r.score) for r in catalog.QUERIES[name](spark, SF).collect()}
        want = best(weight)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want) and want
    shown = defaultdict(list)
    for (q, i), (n, _) in sorted(best(lambda e: 1).items(), key=lambda x: (x[0][0], x[1][0])):
        if beliefs[i].lock_level == "none":
            shown[q].append((i, math.ceil(len(beliefs[i].content) / 4)))
    want = set()
    for q, rows in shown.items():
        spent = 0
        for i, cost in rows:
            spent += cost
            if spent > 4000:
                break
            want.add((q, i, cost, spent))
    assert {(r.query_id, r.belief_id, r.tokens, r.spent) for r in catalog.QUERIES["extracted_lane"](spark, SF).collect()} == want
    known = {e for s in sets.values() for e in s}
    novel = {(q, e["lower"]) for q, found in turns.items() for e in found if e["lower"] not in known}
    assert {(r.query_id, r.entity_lower) for r in catalog.QUERIES["extracted_novelties"](spark, SF).collect()} == novel
    scores = {}
    for i, found in own.items():
        d = sum(e["kind"] in ("file_path", "error_code") or (e["kind"] == "identifier" and not re.fullmatch(r"\d+", e["lower"])) for e in found)
        t = sum(e["kind"] in ("version", "branch") or (e["kind"] == "identifier" and bool(re.fullmatch(r"\d+", e["lower"]))) for e in found)
        if d + t:
            scores[i] = round(d / (d + t + 1), 6)
    assert {r.belief_id: r.score for r in catalog.QUERIES["extracted_persistence"](spark, SF).collect()} == scores


def test_rebuilt_queries(spark):
    """Entities and phrases once each, in order; longer words where there are none; blank turns give nothing."""
    from recallgrid.functions.extract import query_of
    from recallgrid.operators.ingest import rebuilt_queries

    turns = [(1, k, "user", t) for k, t in enumerate(["old words", "see src/app/main.py and fooBar", "The cache supports the index.", "see SRC/app/main.py", "v1.2.3 then"])]
    turns += [(2, 0, "user", ""), (2, 1, "assistant", None), (3, 0, "user", "123 4567 12345 4567")]
    got = {r.conv_id: r.query for r in rebuilt_queries(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == query_of([t for _, _, _, t in turns[1:5]]) and "src/app/main.py" in got[1] and "SRC/app/main.py" not in got[1] and "v1.2.3" in got[1]
    assert "old words" not in got[1] and got[2] == "" and got[3] == "4567 12345"
    assert catalog.QUERIES["rebuilt_context"](spark, SF).count() > 0


def test_triples_are_those_of_the_whole_patterns_and_cost_little():
    """Matches start at the few words before a verb; texts without a verb are not searched by its pattern. The whole patterns took about a second for 30,000 words."""
    import random
    import re
    import time

    def plain(text):
        out = []
        for verb, relation, turned in extract.VERBS:
            pattern = rf"(?i)(?<![\w-])({extract.NOUN_PHRASE})\s+{r'\s+'.join(verb.split())}\s+({extract.NOUN_PHRASE})"
            for m in re.finditer(pattern, text):
                one, other = (" ".join(g.split()) for g in m.groups())
                one, other = (other, one) if turned else (one, other)
                out.append({"subject": one, "relation": relation, "object": other, "anchor": extract._anchor(text, m.start(), m.end())})
        return sorted(out, key=lambda t: text.find(t["anchor"]))

    rng = random.Random(5)
    words = "the a this alpha Beta-x _q 9n -z é supports TESTS is based on supported by related to follows comes after test for ſupports İs ıs cites , x-".split()
    n = 0
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "-", "\u00a0", "  "]) for _ in range(rng.randrange(1, 60)))
        assert extract.find_triples(text) == plain(text)
        n += len(plain(text))
    assert n > 100
    long = "The alpha module supports the beta layer. " + " ".join(rng.choice("alpha beta gamma delta of and to").lower() + "on" for _ in range(30_000))
    begun = time.process_time()
    extract.find_triples(long)
    ours, begun = time.process_time() - begun, time.process_time()
    plain(long)
    assert 10 * ours < time.process_time() - begun


def test_entities_leave_a_task_as_they_are_found(spark, monkeypatch):
    """Rows of few texts come before the next texts are looked at, and are those of the column; a batch's own were held at once before."""
    from pyspark.sql import functions as F

    from recallgrid.functions import extract
    from recallgrid.operators import ingest

    texts = [("a", "see src/app/main.py on feat/x"), ("b", None), ("c", ""), ("d", "v1.2.3 fails"), ("e", "foo.bar and my_var")] * 3
    rows = [(f"{i}{n}", t) for n, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string").coalesce(1)
    monkeypatch.setattr(extract, "HELD", 2)
    want = sorted((i, e["lower"], e["kind"], e["start"]) for i, t in rows for e in extract.find_entities(t or ""))
    assert sorted(map(tuple, ingest.entity_table(df).collect())) == want
    by_column = df.select("id", F.explode(extract.entities(F.col("content"))).alias("e")).select("id", "e.lower", "e.kind", "e.start")
    assert sorted(map(tuple, by_column.collect())) == want
    assert extract.entity_rows(df.where("id = 'none'")).isEmpty()


def test_every_turn_asks(spark):
    """Turns of all ids are queries, not only those divisible by 20 as before."""
    store = load(spark, SF)
    beliefs = {r.id: {e["lower"] for e in find_entities(r.content or "")} for r in store.active.collect()}
    turns = {r.conv_id * 100 + r.turn: {e["lower"] for e in find_entities(r.text or "")} for r in store.turns.collect()}
    want = {}
    for q, wanted in turns.items():
        scored = sorted((-len(wanted & found), i) for i, found in beliefs.items() if wanted & found)[:20]
        want |= {(q, i): (place, -score, float(-score)) for place, (score, i) in enumerate(scored, 1)}
    got = {(r.query_id, r.belief_id): (r.place, r.overlap, r.score) for r in catalog.QUERIES["extracted_overlap"](spark, SF).collect()}
    assert got == want and any(q % 20 for q, _ in want)


def test_blocks_give_what_a_join_gives(spark, monkeypatch):
    """The most shared of many small blocks are those of plain sets, with ties, and keys of all rows that weigh nothing; few rows leave a task, where each hit did before."""
    import random

    from pyspark.sql import functions as F

    from recallgrid.operators import overlap

    monkeypatch.setattr(overlap, "BLOCK_KEYS", 400)
    rng = random.Random(4)
    sets = {f"b{n}": {"all"} | {f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(6))} for n in range(300)}
    asked = {n: {"all", "none"} | {f"w{rng.randrange(40)}" for _ in range(rng.randrange(5))} for n in range(60)} | {60: {"none"}}
    fan = Counter(e for found in sets.values() for e in found)
    rows = spark.createDataFrame([(i, e) for i, found in sets.items() for e in found], "belief_id string, entity_lower string")
    wanted = spark.createDataFrame([(q, e) for q, found in asked.items() for e in found], "query_id long, entity_lower string")
    for weight, of in ((None, lambda e: 1.0), (F.log(F.lit(301.0)) - F.log(F.col("fan") + 1.0), lambda e: math.log(301.0) - math.log(fan[e] + 1.0))):
        got = overlap.most_shared(wanted, rows, 7, weight)
        want = set()
        for q, found in asked.items():
            scored = sorted((-round(math.fsum(of(e) for e in found & own), 6) + 0.0, i, len(found & own)) for i, own in sets.items() if found & own)[:7]
            want |= {(q, i, n, -score + 0.0, place) for place, (score, i, n) in enumerate(scored, 1)}
        assert {(r.query_id, r.belief_id, r.overlap, r.score + 0.0, r.place) for r in got.collect()} == want and len(want) == 420
    assert overlap.most_shared(wanted.where("query_id = 60"), rows, 7).isEmpty() and overlap.most_shared(wanted, rows.limit(0), 7).isEmpty()


def test_patterns_are_tried_where_they_can_match():
    """What a pattern needs is looked for first: texts full of words cost less than half of what all patterns cost, and every kind is found still."""
    import re
    import time

    text = "Look, src/app/main.py C:\\x\\y.txt http://a.b/c HTTPS 404 E1234 ValueError sqlite3.Oops v1.2.3 feat/x foo.bar my_var FooBar"
    assert [e["kind"] for e in find_entities(text)].count("error_code") == 4 and {e["kind"] for e in find_entities(text)} == {k for k, _ in extract.ENTITY_PATTERNS}
    plain = "Many words of a text. And more of them, " * 5000
    begun = time.process_time()
    find_entities(plain)
    ours, begun = time.process_time() - begun, time.process_time()
    for kind, pattern in extract.ENTITY_PATTERNS[3:8]:
        if kind != "branch":
            assert not re.findall(pattern, plain)
    assert 2 * ours < time.process_time() - begun
