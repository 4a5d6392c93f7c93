"""Conflicts with locks and opportunities in a stream against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import locks
from recallgrid.plans.session import new_folder
from recallgrid.streaming import opportunities


def plain_conflicts(candidates, held, tolerance=0.01):
    """The first lock whose value of a shared key isn't close; texts are lists of (key, value)."""
    out = {}
    for i, slots in candidates:
        for rank, lock, values in sorted(held):
            apart = [(k, v, w) for k, v in slots for x, w in values if x == k and v != w and abs(v - w) > tolerance * max(abs(v), abs(w))]
            if apart:
                out[i] = lock
                break
    return out


@pytest.mark.parametrize("spread", [3, 400])
def test_first_conflicting_lock(spark, spread):
    """Many locks of few keys, values close to each other, negative and zero; ranks in no order of values."""
    rng = random.Random(spread)

    def slots():
        keys = rng.sample(["alpha", "beta", "gamma"], rng.randrange(1, 3))
        return [(k, rng.choice([0, 100, -50, 100 + rng.randrange(-spread, spread), rng.randrange(-3, 4)])) for k in keys]

    def text(s):
        return " and ".join(f"{k} = {v}" for k, v in s)

    held = [(rng.randrange(10**6), f"l{n}", slots()) for n in range(120)]
    candidates = [(f"c{n}", slots()) for n in range(200)] + [("none", []), ("other", [("delta", 5)])]
    got = locks.conflicting_locks(spark.createDataFrame([(i, text(s)) for i, s in candidates], "id string, text string"), spark.createDataFrame([(i, r, text(s)) for r, i, s in held], "lock_id string, rank long, text string"))
    assert {r.id: r.lock_id for r in got.collect()} == plain_conflicts(candidates, held)


def test_what_shows_no_conflict(spark):
    """Versions, years, keys of several values; states of one group; texts without slots and nulls."""
    held = [("a", 1, "version = 3 and limit = 10"), ("b", 2, "year 2024, mode is synchronous"), ("c", 3, "size = 4 size = 5"), ("d", 4, "strict and read-only"), ("e", 5, None)]
    asks = [("1", "version = 4"), ("2", "limit = 10.05"), ("3", "limit = 11"), ("4", "sync mode, year 2020"), ("5", "async, size = 9"), ("6", "size = 1 size = 2"), ("7", "lax"), ("8", "readonly"), ("9", None), ("10", "")]
    got = locks.conflicting_locks(spark.createDataFrame(asks, "id string, text string"), spark.createDataFrame(held, "lock_id string, rank long, text string"))
    assert {r.id: r.lock_id for r in got.collect()} == {"3": "a", "5": "b", "7": "d"}


def plain_opportunities(rows, idle, most):
    state, out = {}, []
    for session, n, at, reason, topic in sorted(rows, key=lambda r: r[1]):
        last, seen = state.get(session, (None, set()))
        if last is not None and at - last > idle:
            last, seen = None, set()
        if reason and not (reason == "contradiction" and last is None) and len(seen) < most and (reason, topic) not in seen:
            seen.add((reason, topic))
            out.append((session, n, reason, topic))
        state[session] = at, seen
    return sorted(out)


def test_opportunities_over_batches(spark):
    """A log in four files, one a batch, stopped after two and gone on with; sessions that fall silent for a while."""
    rng = random.Random(6)
    rows = [(rng.randrange(6), n, n * 40 + rng.randrange(5) + (n // 100) * 3000, rng.choice([None, "gap", "new_entity", "contradiction"]), str(rng.randrange(5))) for n in range(400)]
    folder = new_folder(spark, "turns")
    schema = "session_id long, feedback_id long, seconds long, reason string, topic string"

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")

    def run():
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log").withColumn("at", F.timestamp_seconds("seconds"))
        found = opportunities.opportunities(opportunities.candidates(log, F.col("reason"), F.col("topic")), 1500, 600)
        return sorted(map(tuple, opportunities.run_available(found, "found", f"{folder}/out").collect()))

    for k in range(2):
        put(rows[k * 100 : k * 100 + 100])
    assert run() == plain_opportunities(rows[:200], 1500, 3)
    for k in range(2, 4):
        put(rows[k * 100 : k * 100 + 100])
    want = plain_opportunities(rows, 1500, 3)
    assert run() == want and len(want) > 20 and {r[2] for r in want} == set(opportunities.REASONS)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_rotated_log_is_followed(spark):
    """Three files of lines, read one a batch in two runs: the stream's rings are those of all lines at once."""
    from recallgrid.streaming import feedback, ring

    rng = random.Random(8)
    kind = "ts long, key long, n long, session string"
    events = [(n * 10, rng.randrange(4), n, f"s{(n + rng.randrange(2)) // 40}") for n in range(300)]
    lines = [f'{{"ts": {t}, "key": {k}, "n": {n}, "session": "{s}"}}' for t, k, n, s in events]
    lines = [x if i % 31 else x[: len(x) // 2] for i, x in enumerate(lines)]
    folder = new_folder(spark, "audit")

    def run(parts):
        for part in parts:
            spark.createDataFrame([(x,) for x in (*part, "", "[]")], "value string").coalesce(1).write.mode("append").text(folder)
        log = ring.followed(spark, folder, kind, 500, None, 1)
        return feedback.run_available(ring.rings(log, F.col("key"), F.col("session"), F.col("n"), 5), "rings")

    got = {(r.key, r.n): (r.fire_idx, r.held, r.evicted) for r in run([lines[:100], lines[100:200], lines[200:]]).collect()}
    batch = ring.parsed(spark.read.text(folder), kind, 500)
    want, last = {}, {}
    for r in sorted(batch.collect(), key=lambda r: r.n):
        session, seen = last.get(r.key, (None, 0))
        seen = seen + 1 if session == r.session else 1
        last[r.key] = r.session, seen
        want[r.key, r.n] = seen - 1, min(seen, 5), max(0, seen - 5)
    assert got == want and len(want) == sum(1 for i, e in enumerate(events) if i % 31 and e[0] >= 500)


def test_numbers_after_words_cost_little(spark):
    """What is looked for ahead changes no match, and a text of words without numbers isn't gone over again for each length of a word."""
    import random
    import time

    from pyspark.sql import functions as F

    from recallgrid.functions import detect

    rng = random.Random(7)
    parts = ["a", "limit", "x_1", "is", "of", "to", "equal", "equals", "=", ":", " ", " ", "  ", "\n", "5", "12.5", "-3", "+4", "1e9", "é", "_", "w" * 33, "9ab", ".", "isx"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))),) for _ in range(4000)], "text string")
    old, new = (F.regexp_extract_all("text", F.lit(detect.edged(p)), F.lit(0)) for p in (detect.NUMERIC, detect.NUMERIC_AHEAD + detect.NUMERIC))
    assert rows.where(old != new).isEmpty() and rows.where(F.size(new) > 1).count() > 100
    long = spark.createDataFrame([("consideration of international representatives " * 30_000,)], "text string").select(F.concat("text", F.lit("limit = 5")).alias("text"))

    def seconds(pattern):
        start = time.time()
        assert long.select(F.regexp_extract_all("text", F.lit(detect.edged(pattern)), F.lit(3))).first()[0] == ["5"]
        return time.time() - start

    assert min(seconds(detect.NUMERIC_AHEAD + detect.NUMERIC) for _ in range(2)) < seconds(detect.NUMERIC) / 2


def test_a_value_that_many_candidates_have_is_held_against_the_locks_once(spark):
    """The plan joins distinct values with locks, and their lock with the candidates."""
    asks = [(f"c{k}", f"limit = {k % 3 * 10}, sync") for k in range(60)]
    held = [("l1", 1, "limit = 10"), ("l2", 2, "limit = 20"), ("l3", 3, "async")]
    got = locks.conflicting_locks(spark.createDataFrame(asks, "id string, text string"), spark.createDataFrame(held, "lock_id string, rank long, text string"))
    assert {r.id: r.lock_id for r in got.collect()} == {f"c{k}": "l2" if k % 3 == 1 else "l1" for k in range(60)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
