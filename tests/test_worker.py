"""The derivation stream, killed at every place and started anew, and evidence that comes out of order, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import ordered
from recallgrid.plans.session import new_folder
from recallgrid.streaming import worker

SF = "/root/testdata/sf0.001"
PARTS = ("beliefs", "stamps", "corroborations", "edges", "heads", "ledger")


class Killed(Exception):
    pass


def tables(made):
    rows = {name: sorted((tuple(r) for r in made.table(name).drop("batch").collect()), key=repr) for name in PARTS if name not in ("heads", "ledger")}
    rows["log rows"] = sum(r.rows for r in made.table("ledger").collect())
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    """The turns in three files, some of them said again later."""
    folder = new_folder(spark, "turns")
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    asked = rows.where("turn = 0 AND conv_id < 9").withColumns({"turn": F.lit(91).cast("long"), "text": F.lit("What is this?")})
    rows = rows.unionByName(asked)
    third = F.pmod("conv_id", F.lit(3))
    for n in range(3):
        part = rows.where(third == n)
        if n:
            part = part.unionByName(rows.where((third == n - 1) & (F.col("turn") < 2)).withColumn("turn", F.col("turn") + 50))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/conversations.parquet")
    return folder


def stream(spark, folder):
    """One file a batch, in an order that stays."""
    schema = spark.read.parquet(f"{folder}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/conversations.parquet")
    log_id = F.col("conv_id") * 100 + F.col("turn")
    kind = F.when(log_id % 7 == 0, "remember").when(log_id % 5 == 0, "git").otherwise("transcript")
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    return turns.select(log_id.alias("log_id"), kind.alias("source_kind"), F.col("text").alias("raw_text"), session.alias("session_id"), (F.col("conv_id") * 3600 + F.col("turn")).alias("created_at"), "role")


def test_a_killed_stream_leaves_what_a_whole_one_does(spark, conversations):
    want = tables(worker.run(stream(spark, conversations)))
    assert want["corroborations"] and want["edges"] and want["log rows"] == spark.read.parquet(f"{conversations}/conversations.parquet").count()
    assert {a for _, _, a in want["stamps"]} == {"inserted", "corroborated", "skipped"}
    folder, calls = new_folder(spark, "killed"), {"n": 0}

    def killing(step):
        calls["n"] += 1
        if calls["n"] in (1, 4, 8, 13, 19, 26):
            raise Killed(step)

    for _ in range(40):
        try:
            made = worker.run(stream(spark, conversations), folder, killing)
            break
        except Exception as e:
            assert "Killed" in str(e)
    assert calls["n"] > 8 and tables(made) == want
    # A batch that is complete isn't made again, and nothing new leaves all as it is.
    assert tables(worker.run(stream(spark, conversations), folder)) == want


def test_each_text_is_inserted_once(spark, conversations):
    made = worker.run(stream(spark, conversations))
    beliefs = made.table("beliefs")
    assert beliefs.count() == beliefs.select("content_hash").distinct().count() == made.table("stamps").where("action = 'inserted'").count()
    assert made.table("stamps").where("belief_id IS NOT NULL").join(beliefs, F.col("belief_id") == F.col("id"), "left_anti").isEmpty()


def test_worker_of_no_rows(spark):
    made = worker.Worker(spark, new_folder(spark, "none"))
    made.add(spark.createDataFrame([], worker.LOG), 0)
    assert all(made.table(t).isEmpty() for t in PARTS[:5]) and made.table("ledger").first().rows == 0


def plain_meta(events, half_life):
    """Evidence beyond the prior by one event after another."""
    up = down = 0.0
    last = None
    for at, e in events:
        age = 0 if last is None else max(0, at - last)
        f = 2 ** (-age / half_life) if half_life > 0 and age > 0 else 1.0
        e = min(1.0, max(0.0, e))
        up, down, last = up * f + e, down * f + 1 - e, at
    return up, down, last


@pytest.mark.parametrize("cuts", [1, 2, 9])
def test_evidence_may_be_cut_anywhere(spark, cuts):
    """Times that go back, one key with most events, half-lives of zero; the log folded in parts of any sizes."""
    rng = random.Random(cuts)
    rows, half = [], {"hot": 500.0, "a": 50.0, "none": 0.0}
    for n in range(400):
        rows.append((n, rng.choice(["hot"] * 8 + ["a", "none"]), n * 10 + rng.randrange(-200, 200), rng.uniform(-0.5, 1.5)))
    bounds = sorted(rng.sample(range(1, 400), cuts - 1))
    df = spark.createDataFrame([(n, k, at, e, half[k], sum(n >= b for b in bounds)) for n, k, at, e in rows], "n int, key string, at long, evidence double, half_life double, part int").repartition(5)
    parts = ordered.joined_segments(ordered.meta_events(df), ["key", "part"], [F.col("n")])
    got = {r.key: r for r in ordered.meta_posteriors(ordered.joined_segments(parts, ["key"], [F.col("part")]), ["key"], F.lit(0.25)).collect()}
    assert set(got) == set(half)
    for k in half:
        up, down, last = plain_meta([(at, e) for _, key, at, e in rows if key == k], half[k])
        assert abs(got[k].alpha - 0.25 - up) < 1e-9 and abs(got[k].beta - 0.75 - down) < 1e-9 and got[k].last_at == last


def test_log_of_a_folder_of_files(spark, tmp_path):
    """A table of many files is a folder, whose files have names of their own."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(40)
    rows.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    made = worker.run(worker.log_stream(spark, str(tmp_path)))
    assert made.table("stamps").count() == 40
