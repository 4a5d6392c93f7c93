"""An exported history against a plain reading, and scans that add nothing the second time."""

from pyspark.sql import functions as F

from recallgrid.plans.session import new_folder
from recallgrid.sources import history


def test_log_is_read_by_records(spark, tmp_path):
    """Subjects with tabs, commits without files or subject, broken records, windows line ends, and splits inside records."""
    made = [(f"{n:040x}", f"2024-01-{1 + n % 28:02}T10:00:00+02:00", f"fix\tthing {n}" if n % 7 else " ", [f"src/a{n % 5}.py", f"dir b/c{n}.md"] if n % 3 else []) for n in range(400)]
    text = "".join("\x1e" + "\t".join((sha, at, subject)) + ("\n\n" + "\r\n".join(files) + "\n" if files else "\n") for sha, at, subject, files in made) + "\x1ebroken record\n"
    (tmp_path / "log").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = history.commits(spark, f"{tmp_path}/log")
        assert log.rdd.getNumPartitions() > 3
        got = sorted((r.sha, r.subject, tuple(r.files)) for r in log.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((sha, subject.strip(), tuple(files)) for sha, _, subject, files in made)
    recent = {}
    for _, at, _, files in made:
        for f in files:
            recent[f] = max(recent.get(f, ""), at)
    found = {r.path: r.at for r in history.file_recency(log).select("path", F.date_format(F.to_utc_timestamp(F.col("at"), "UTC"), "yyyy-MM-dd").alias("at")).collect()}
    assert found == {f: at[:10] for f, at in recent.items()}
    some = history.commit_candidates(log, 5).collect()
    assert len(some) <= 5 and all(r.source.startswith("git:commit:") and len(r.source) == 18 and r.text for r in some)


def test_a_second_scan_adds_nothing(spark):
    folder = new_folder(spark, "scan")
    rows = [("a paragraph that is long enough", "doc:x:p0", 5), ("a paragraph that is long enough", "doc:a:p3", None), ("short", "git:commit:1", 7), ("known already, and said again", "doc:y:p1", 3)]
    found = spark.createDataFrame(rows, "text string, source string, at long")
    known = spark.createDataFrame([("known already, and said again",)], "t string").select(F.sha2("t", 256).alias("content_hash"))
    first = history.scanned(found, known, F.length("text") > 5)
    assert [(r.text, r.source, r.at, r.seen) for r in first.collect()] == [("a paragraph that is long enough", "doc:a:p3", None, 2)]
    first.write.parquet(folder)
    after = known.unionByName(spark.read.parquet(folder).select("content_hash"))
    assert history.scanned(found, after, F.length("text") > 5).isEmpty()


def test_an_empty_history(spark, tmp_path):
    (tmp_path / "log").write_text("")
    log = history.commits(spark, f"{tmp_path}/log")
    assert log.isEmpty() and history.file_recency(log).isEmpty() and history.commit_candidates(log).isEmpty()


def test_log_rows(spark):
    """The same row twice is one; kinds that aren't known are an error; a row that is there stays as it is."""
    import pytest

    from recallgrid.operators import ledger

    schema = "source_kind string, source_path string, raw_text string, raw_meta map<string,string>, derived_ids array<string>, session_id string, created_at long"
    rows = [("git", None, "a", None, None, None, 1), ("git", "", "a", {"k": "v"}, ["b"], "", 1), ("transcript", "p", "t", {"x": "é"}, [], "s", 2)]
    made = ledger.log_rows(spark.createDataFrame(rows, schema))
    assert made.select("log_id").distinct().count() == 2
    log = made.limit(0)
    once = ledger.append_log(log, made)
    assert once.count() == 2 and ledger.append_log(once, made).count() == 2
    got = once.where("source_kind = 'transcript'").first()
    assert (got.raw_meta, got.derived_ids, got.created_at, len(got.log_id)) == ('{"x":"é"}', "[]", 2, 26)
    with pytest.raises(ValueError, match="unknown source kind: 'mail'"):
        ledger.log_rows(spark.createDataFrame([("mail", None, "a", None, None, None, 1)], schema))


def test_feed_log(spark):
    from recallgrid.sources import files

    folder = new_folder(spark, "feed")
    files.append_feed(spark.createDataFrame([(1, "a", "x", None), (2, "b", None, 0.5)], "ts long, event string, id string, v double"), folder)
    spark.createDataFrame([("",), ("{broken",), ("[]",)], "value string").write.mode("append").text(folder)
    files.append_feed(spark.createDataFrame([(3, "c", "tab\tand\nline")], "ts long, event string, id string"), folder)
    got = sorted(map(tuple, files.read_feed(spark, folder, "ts long, event string, id string, v double").collect()))
    assert got == [(1, "a", "x", None), (2, "b", None, 0.5), (3, "c", "tab\tand\nline", None)]


def test_peers_of_a_configuration(spark, tmp_path):
    import json

    import pytest

    from recallgrid.sources import peers

    (tmp_path / "there").mkdir()
    spark.range(3).selectExpr("CAST(id AS STRING) AS id").write.parquet(f"{tmp_path}/there/beliefs")
    config = tmp_path / "deps.json"
    assert peers.load_peers(spark, str(config)) == []
    config.write_text(json.dumps({"version": 1, "deps": [{"name": "a", "path": "there"}, {"name": "b", "path": f"{tmp_path}/gone"}]}))
    a, b = peers.load_peers(spark, str(config))
    assert (a.name, a.path, a.reachable, b.reachable) == ("a", f"{tmp_path}/there", True, False)
    assert peers.open_peer(spark, a).beliefs.count() == 3
    with pytest.raises(ValueError, match="isn't there"):
        peers.open_peer(spark, b)
    for bad in ("{", "[]", '{"version": 2}', '{"version": 1, "deps": {}}'.replace("{}", '{"x": 1}'), '{"version": 1, "deps": [{"name": "a"}]}', '{"version": 1, "deps": [{"name": "a", "path": "x"}, {"name": "a", "path": "y"}]}'):
        config.write_text(bad)
        with pytest.raises(ValueError):
            peers.load_peers(spark, str(config))
