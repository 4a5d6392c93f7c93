"""Every query of the catalog beside its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from recallgrid.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rel = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ordered(df.select(*columns).collect()) == ordered([r[i] for i in at] for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_walks_start_from_every_active_belief(spark):
    """Against plain walks in Python from every active belief; a belief outside the ids divisible by 50 is a seed too."""
    from recallgrid.operators.graph import WALK
    from recallgrid.sources.model import load

    store = load(spark, SF_DIR)
    active = {r.id for r in store.beliefs.where("valid_to IS NULL").collect()}
    out = {}
    for e in store.edges.collect():
        a, b = (e.dst, e.src) if e.type == "SUPERSEDES" else (e.src, e.dst)
        if b in active and WALK.get(e.type, 0) > 0:
            out.setdefault(a, []).append((b, WALK[e.type]))
    want = {}
    for seed in active:
        front = [(seed, 1.0)]
        for _ in range(2):
            front = [(b, x * w) for a, x in front for b, w in out.get(a, []) if x * w >= 0.1]
            for b, x in front:
                if b != seed:
                    want[seed, b] = max(want.get((seed, b), 0.0), x)
    got = {(r.seed, r.node): r.score for r in catalog.QUERIES["multi_hop_reach"](spark, SF_DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert any(int(s[1:]) % 50 for s, _ in got)
    assert sum(r.n for r in catalog.QUERIES["compare_slots"](spark, SF_DIR).collect()) >= store.beliefs.count()


def test_long_chains_are_one_component(spark):
    """A path of 400 nodes in random order of ids, for which spreading least labels takes over 30 rounds, and a loop."""
    import random

    from recallgrid.operators.graph import components

    order = list(range(400))
    random.Random(400).shuffle(order)
    edges = [(a, b) for a, b in zip(order[:-1], order[1:], strict=True)] + [(900, 900), (902, 901)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {900: 900, 901: 901, 902: 901}
