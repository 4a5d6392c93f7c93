"""Scans over ranges, draws and eigenpairs against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import graph, sampling, spectrum, vectors
from recallgrid.operators.scan import Ranges
from recallgrid.sources.model import load

SF = "/root/testdata/sf0.001"


def test_scans_carry_over_ranges(spark):
    """One group with most of the rows, small ones, a null group and one of a single row, over many ranges."""
    rng = random.Random(2)
    rows = [("hot", i, rng.randrange(-5, 6)) for i in range(500)] + [(f"g{i % 9}", i, None if i % 7 == 0 else i) for i in range(60)] + [(None, i, 2) for i in range(5)] + [("z", 0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        ranges = Ranges(df, ["g"], [F.col("o")])
        assert ranges.rows.where("g = 'hot'").select("_rg_range").distinct().count() > 5
        got = {(r.g, r.o): (r.total, r.place) for r in ranges.running_sums(total=F.col("v"), place=F.lit(1)).collect()}
        before = {(r.g, r.o): r.was for r in ranges.previous(was="v").collect()}
        everywhere = {(r.g, r.o): r.n for r in Ranges(df, [], [F.col("g"), F.col("o")]).places("n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = defaultdict(list)
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        by[g].append((o, v))
    for g, group in by.items():
        total, was = 0, None
        for n, (o, v) in enumerate(group, 1):
            total += v or 0
            assert got[g, o] == (total, n) and before[g, o] == was
            was = v
    assert [everywhere[g, o] for g, group in by.items() for o, _ in group] == list(range(1, len(rows) + 1))


def test_scans_of_no_rows(spark):
    ranges = Ranges(spark.createDataFrame([], "g string, o int"), ["g"], [F.col("o")])
    assert ranges.places().isEmpty() and ranges.previous(was="o").isEmpty()


def test_walks_do_not_depend_on_partitions(spark):
    store = load(spark, SF)

    def walks(own, seed):
        return {(tuple(r.composition), r.seed_id, r.cost) for r in sampling.random_walks(own, 60, seed).collect()}

    some = walks(store, "s")
    spread = store.replaced(edges=store.edges.repartition(13), beliefs=store.beliefs.repartition(7))
    assert some and some == walks(spread, "s") and some != walks(store, "t")
    edges = {(r.src, r.dst) for r in store.edges.collect()}
    for r in sampling.random_walks(store, 60, "s").collect():
        assert 2 <= len(r.composition) <= 3 and r.seed_id in r.composition and any((r.seed_id, x) in edges for x in r.composition)


def test_walks_take_every_edge_alike(spark):
    """From one belief with four edges each is taken about as often."""
    store = load(spark, SF)
    beliefs = store.beliefs.where("id = 'd1'").withColumns({"alpha": F.lit(1.0), "beta": F.lit(1.0)})
    edges = spark.createDataFrame([("d1", f"x{i}", "CITES", 1.0, "") for i in range(4)], "src string, dst string, type string, weight double, anchor_text string")
    own = store.replaced(beliefs=beliefs, edges=edges)
    taken = Counter(sampling.random_walks(own, 1, f"seed {i}", depth=1).first().composition[1] for i in range(40))
    assert set(taken) == {"x0", "x1", "x2", "x3"}
    drawn = Counter(r.n for r in spark.range(4000).select(sampling.chosen(F.lit(4), F.lit("s"), "id").alias("n")).collect())
    assert set(drawn) == {1, 2, 3, 4} and max(abs(c - 1000) for c in drawn.values()) < 120


@pytest.mark.parametrize("size", [2, 3])
def test_compositions_span_sessions(spark, size):
    """All sets of sessions come up about as often; a session's beliefs are each used once before any is used again."""
    store = load(spark, SF)
    rows = [(f"{s}{i}", s) for s, n in (("a", 3), ("b", 40), ("c", 400), ("d", 5)) for i in range(n)] + [("no", None), ("none", "")]
    own = store.replaced(beliefs=spark.createDataFrame(rows, "id string, session_id string"))
    got = [r.composition for r in sampling.session_compositions(own, 600, "x", size).collect()]
    sets = Counter("".join(sorted(x[0] for x in c)) for c in got)
    assert all(len({x[0] for x in c}) == size for c in got) and set(sets) == {"".join(c) for c in itertools.combinations("abcd", size)}
    used = Counter(x for c in got for x in c)
    assert sum(x[0] == "c" for x in used) > 200 and max(n for x, n in used.items() if x[0] == "c") <= 2


def test_compositions_need_enough_sessions(spark):
    store = load(spark, SF)
    own = store.replaced(beliefs=spark.createDataFrame([("a", "s"), ("b", "s")], "id string, session_id string"))
    assert sampling.session_compositions(own, 5, "x").isEmpty()


def dense(laplacian):
    rows = laplacian.collect()
    ids = sorted({r.i for r in rows})
    at = {x: n for n, x in enumerate(ids)}
    m = np.eye(len(ids))
    for r in rows:
        m[at[r.i], at[r.j]] = r.v
    return ids, m


def test_least_eigenpairs_of_the_store(spark):
    laplacian = graph.signed_laplacian(load(spark, SF), None)
    ids, m = dense(laplacian)
    values, left, table = spectrum.least_eigenpairs(laplacian, 6)
    assert np.allclose(values, np.linalg.eigvalsh(m)[:6], atol=1e-6) and (left < 1e-6).all()
    found = {r.i: r.v for r in table.collect()}
    v = np.array([found[i] for i in ids])
    assert np.allclose(m @ v, v * values, atol=1e-6) and np.allclose(v.T @ v, np.eye(6), atol=1e-8)


def test_heat_of_all_eigenpairs_is_the_series(spark):
    """A small graph, of which every pair is found: heat by the basis is that of the Chebyshev series."""
    store = load(spark, SF)
    rng = random.Random(4)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(40)}
    rows = [(f"n{a:02}", f"n{b:02}", rng.choice(["SUPPORTS", "CITES", "CONTRADICTS"]), 0.5, "") for a, b in sorted(edges) if a != b]
    own = store.replaced(edges=spark.createDataFrame(rows, "src string, dst string, type string, weight double, anchor_text string"))
    ids, m = dense(graph.signed_laplacian(own))
    values, left, table = spectrum.least_eigenpairs(graph.signed_laplacian(own), len(ids))
    assert np.allclose(values, np.linalg.eigvalsh(m), atol=1e-8) and (left < 1e-6).all()
    seeds = spark.createDataFrame([("q", ids[0], 0.75), ("q", ids[3], 0.25), ("r", ids[5], 1.0)], "query_id string, i string, s double")
    by_basis = {(r.query_id, r.i): r.s for r in spectrum.heat_by_basis(values, table, seeds, 2.0).collect()}
    series = {(r.query_id, r.i): r.s for r in vectors.heat(own, seeds, 2.0).collect()}
    assert all(abs(by_basis[k] - series.get(k, 0.0)) < 1e-6 for k in by_basis) and len(by_basis) == 2 * len(ids)


def test_eigenpairs_by_components(spark):
    """Paths of two to five nodes and a cycle of forty: each small one gives a zero, and the pairs are those of the dense matrix whether the cycle is solved by steps or not."""
    links = [(f"p{n}_{x}", f"p{n}_{x + 1}", 1.0) for n in range(2, 6) for x in range(n - 1)]
    links += [(f"c{x:02}", f"c{(x + 1) % 40:02}", -1.0 if x == 0 else 1.0) for x in range(40)]
    rows = spark.createDataFrame([e for a, b, w in links for e in ((a, b, w), (b, a, w))], "i string, j string, w double")
    d = rows.groupBy("i").agg(F.sum(F.abs("w")).alias("d"))
    laplacian = rows.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("d") * F.col("dj"))).alias("v"))
    ids, m = dense(laplacian)
    for most, k in ((512, 8), (8, 4)):
        values, left, table = spectrum.least_eigenpairs(laplacian, k, dense=most)
        found = {r.i: r.v for r in table.collect()}
        v = np.array([found[i] for i in ids])
        assert np.allclose(values, np.linalg.eigvalsh(m)[:k], atol=1e-8) and (left < 1e-6).all()
        assert np.allclose(m @ v, v * values, atol=1e-6) and np.allclose(v.T @ v, np.eye(k), atol=1e-8)


def test_steps_find_no_pair_twice(spark):
    """All pairs of a dense small graph by Lanczos steps: no value from outside the spectrum, none missing."""
    rng = random.Random(4)
    w = np.zeros((14, 14))
    for _ in range(40):
        a, b = rng.sample(range(14), 2)
        w[a, b] = w[b, a] = rng.choice([0.5, -0.5])
    d = np.abs(w).sum(1)
    rows = [(f"n{a:02}", f"n{b:02}", float(-w[a, b] / np.sqrt(d[a] * d[b]))) for a in range(14) for b in range(14) if w[a, b]]
    laplacian = spark.createDataFrame(rows, "i string, j string, v double")
    ids, m = dense(laplacian)
    values, left, _ = spectrum.least_eigenpairs(laplacian, len(ids), dense=0)
    assert np.allclose(values, np.linalg.eigvalsh(m), atol=1e-8) and (left < 1e-6).all()


def test_eigenpairs_of_no_edges(spark):
    values, left, table = spectrum.least_eigenpairs(spark.createDataFrame([], "i string, j string, v double"), 3)
    assert len(values) == 0 and len(left) == 0 and table.isEmpty()
