"""The vector index and what is recovered with it against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import recall, vectors
from recallgrid.sources.model import load

SF = "/root/testdata/sf0.001"


def brute(rows, probes, k, least=-np.inf):
    out = {}
    for p, v in probes:
        scored = sorted((-round(float(np.dot(v, w)), 9), i) for i, w in rows)
        out[p] = [(i, -s) for s, i in scored if -s >= least][:k]
    return out


def searched(index, probes, spark, k, **more):
    df = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in probes], "probe string, vector array<double>")
    out = {p: [] for p, _ in probes}
    for r in sorted(index.search(df, k, **more).collect(), key=lambda r: (-r.score, r.id)):
        out[r.probe].append((r.id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for p in want:
        assert [i for i, _ in got[p]] == [i for i, _ in want[p]] and np.allclose([s for _, s in got[p]], [s for _, s in want[p]], atol=2e-9)


@pytest.mark.parametrize("shape", ["isotropic", "clustered"])
def test_index_is_exact(spark, shape):
    """Random vectors, for which most cells must be looked at, and clusters with a third of all rows alike, for which few must."""
    rng = np.random.default_rng(7)
    if shape == "isotropic":
        x = rng.normal(size=(900, 12))
    else:
        centres = rng.normal(size=(30, 12)) * 5
        x = centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 12)) * 0.02
        x = np.vstack([x, np.repeat(x[:1], 300, axis=0)])
    x[5] = 0.0
    rows = [(f"v{i:04}", v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "id string, vector array<double>").repartition(6)
    index = recall.VectorIndex(df)
    probes = [(i, v) for i, v in rows[::60]] + [("zero", np.zeros(12)), ("far", -x[3] * 100)]
    same(searched(index, probes, spark, 7), brute(rows, probes, 7))
    same(searched(index, probes, spark, 7, few=1, least=1.5), brute(rows, probes, 7, 1.5))
    most = recall.bounds(np.array([v for _, v in probes[:-2]]), index.centroids, index.widest, index.longest)
    held = recall.unit(x)[0] @ index.centroids.T
    cell = held.argmax(axis=1)
    for n, (_, v) in enumerate(probes[:-2]):
        assert (most[n][cell] >= x @ v - 1e-9).all()
    if shape == "clustered":
        bar = np.array([brute(rows, [p], 7)[p[0]][-1][1] for p in probes[:-2]])
        assert (most >= bar[:, None]).mean() < 0.5


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03}", v) for i, v in enumerate(np.vstack([np.ones((150, 3)), rng.normal(size=(60, 3))]))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "id string, vector array<double>")
    index = recall.VectorIndex(df)
    assert index.blocks.max() > 5
    same(searched(index, rows[::30], spark, 5), brute(rows, rows[::30], 5))


def test_index_of_no_vectors(spark):
    empty = spark.createDataFrame([], "id string, vector array<double>")
    assert recall.VectorIndex(empty).search(spark.createDataFrame([("p", [1.0])], "probe string, vector array<double>"), 3).isEmpty()
    index = recall.VectorIndex(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>"))
    assert index.search(spark.createDataFrame([], "probe string, vector array<double>"), 3).isEmpty()


def test_cosine_top_drops_what_has_no_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, []), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.q, r.place): (r.r, r.cosine) for r in recall.cosine_top(df, df, 2).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (8, 1): (3, 0.0), (8, 2): (1, -1.0)}


def test_edge_vectors_of_a_hub(spark):
    """A belief with many edges, some twice, against sums made plainly."""
    store = load(spark, SF)
    rows = [("hub", f"t{i % 40}", ["CITES", "SUPPORTS"][i % 2], 1.0, "") for i in range(300)] + [("one", "t1", "TESTS", 1.0, "")]
    own = store.replaced(edges=spark.createDataFrame(rows, "src string, dst string, type string, weight double, anchor_text string").repartition(5))
    got = {r.id: np.array(r.vector) for r in vectors.edge_vectors(own, 64).collect()}
    for src in ("hub", "one"):
        want = sum(vectors.bind(vectors.vector_of("role:" + t, 64), vectors.vector_of(d, 64)) for s, d, t, _, _ in rows if s == src)
        assert np.allclose(got[src], want)


def test_expansion_takes_the_strongest(spark):
    """Two seeds that share a neighbour; retired beliefs and seeds are left out; a table made before gives the same."""
    store = load(spark, SF)
    ids = [(f"b{i}", None if i != 5 else 1) for i in range(8)]
    beliefs = spark.createDataFrame(ids, "id string, valid_to long")
    edges = [("b0", "b1", "CITES"), ("b0", "b2", "TESTS"), ("b3", "b0", "SUPPORTS"), ("b4", "b2", "CITES"), ("b0", "b5", "CITES"), ("b0", "b4", "CITES"), ("b6", "b0", "RELATES_TO")]
    own = store.replaced(beliefs=beliefs, edges=spark.createDataFrame([(*e, 1.0, "") for e in edges], "src string, dst string, type string, weight double, anchor_text string"))
    hits = spark.createDataFrame([("q", "b0", 1), ("q", "b4", 2), ("q", "b7", 6)], "query_id string, id string, place int")
    got = {r.id for r in vectors.expanded_seeds(own, hits).collect()}
    assert got == {"b1", "b2", "b3"}
    table = vectors.neighbours(own, beliefs)
    assert {r.id for r in vectors.expanded_seeds(own, hits, table).collect()} == got
    found = {(r.seed, r.id, r.kind, r.direction) for r in table.where("similarity >= 0.5").collect()}
    want = {(a, b, k, "forward") for a, b, k in edges if k in vectors.EXPANDED} | {(b, a, k, "reverse") for a, b, k in edges if k in vectors.EXPANDED}
    assert found <= want and len(want - found) <= 1  # three of each kind at most: b0 cites b1, b4 and b5


def test_memory_recovers_what_is_bound(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(200)], "id string")
    memory = vectors.name_vectors(names, 512)
    key = vectors.vector_of("role:x", 512)
    made = {f"p{i}": vectors.bind(key, vectors.vector_of(f"n{i}", 512)) + vectors.bind(vectors.vector_of("role:y", 512), vectors.vector_of(f"n{i + 50}", 512)) for i in range(0, 100, 9)}
    noisy = spark.createDataFrame([(p, vectors.unbind(key, v).tolist()) for p, v in made.items()] + [("none", [0.0] * 512)], "probe string, vector array<double>")
    got = {r.probe: r.id for r in vectors.cleaned(memory, noisy, 1).collect()}
    assert got == {p: "n" + p[1:] for p in made}


def test_sample_brings_its_own_vectors_only(spark):
    """Each of eight tasks brought ``SAMPLE`` whole vectors to the driver before; ids are picked first now, and the sample stays the same."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 4))
    df = spark.createDataFrame([(f"v{i}", [float(c) for c in v]) for i, v in enumerate(x)], "id string, vector array<double>").repartition(8)
    want = np.array([r.vector for r in df.orderBy(F.xxhash64("id"), "id").limit(recall.SAMPLE).collect()])
    assert np.array_equal(recall._sampled(df), want)
    assert len(recall._sampled(df.limit(0))) == 0


def test_recovery_tells_near_copies_apart(spark):
    """Near copies that noise brings nearer than the vector it is on, and vectors of several names, more than are asked for at first."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(40, 64))
    x = np.repeat(x / np.linalg.norm(x, axis=1)[:, None], 30, axis=0)
    x = np.vstack([x + rng.uniform(-0.012, 0.012, x.shape), np.repeat(x[:1], 50, axis=0)])
    noisy = x + rng.uniform(-0.025, 0.025, x.shape)
    df = lambda values, name: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(values)], f"{name} long, vector array<double>")
    by_cosine = {r.probe: r.id for r in vectors.cleaned(df(x, "id"), df(noisy, "probe"), 1).collect()}
    assert any(by_cosine[i] != i for i in range(1200))
    got = vectors.recovered(df(x, "id"), df(noisy, "probe"), 0.025, 4).collect()
    assert sorted((r.probe, r.id) for r in got) == [(i, i) for i in range(len(x))]
    other = vectors.recovered(df(x[1200:], "id"), df(noisy[1200:1201], "probe").selectExpr("probe - 1 AS probe", "vector"), 0.025).collect()
    assert [(r.probe, r.id) for r in other] == [(-1, 0)]


def test_neighbours_write_no_vectors(spark, tmp_path, monkeypatch):
    """What probes find in small blocks is what plain products give, a hub's too and with ties at a low floor; folders hold names only, where all vectors stood before."""
    store = load(spark, SF)
    rng = np.random.default_rng(8)
    edges = [(f"b{i}", f"b{rng.integers(60)}", ["CITES", "SUPPORTS", "RELATES_TO"][rng.integers(3)]) for i in range(60)] + [("hub", f"b{i % 50}", "TESTS") for i in range(120)]
    own = store.replaced(
        beliefs=spark.createDataFrame([(f"b{i}", None) for i in range(60)] + [("hub", None), ("hub", None)], "id string, valid_to long"),
        edges=spark.createDataFrame([(*e, 1.0, "") for e in edges], "src string, dst string, type string, weight double, anchor_text string"),
    )
    d, k, floor = 64, 4, 0.2
    folders = []
    for module in (vectors, recall):
        monkeypatch.setattr(module, "new_folder", lambda spark, name: folders.append(str(tmp_path / f"{name}{len(folders)}")) or folders[-1])
    monkeypatch.setattr(vectors, "HELD_ROWS", 3)
    monkeypatch.setattr(vectors, "AT_ONCE", 5)
    names = {i: vectors.vector_of(i, d) for i in [f"b{i}" for i in range(60)] + ["hub"]}
    roles = {t: vectors.vector_of("role:" + t, d) for t in vectors.EXPANDED}
    made = {s: sum(vectors.bind(vectors.vector_of("role:" + t, d), vectors.vector_of(o, d)) for x, o, t in edges if x == s) for s in {s for s, _, _ in edges}}

    def best(probe, of, seed):
        scored = sorted((-round(float(probe @ v), 9), i) for i, v in of.items())
        return [(i, -s) for s, i in scored if -s >= floor][: k + 1], seed

    want = set()
    for seed in ("b0", "b1", "b7", "hub"):
        for kind, role in roles.items():
            for direction, probe, of in (("forward", vectors.unbind(role, made[seed]), names), ("reverse", vectors.bind(role, names[seed]), made)):
                found = [(i, s) for i, s in best(probe, of, seed)[0] if i != seed][:k]
                want |= {(seed, i, kind, direction, round(s, 6)) for i, s in found}
    seeds = spark.createDataFrame([("b0",), ("b1",), ("b7",), ("hub",), ("none",)], "id string")
    got = vectors.neighbours(own, seeds, k, floor, d).collect()
    assert {(r.seed, r.id, r.kind, r.direction, round(r.similarity, 6)) for r in got} == want and len(got) == len(want) > 50
    held = sum(f.stat().st_size for folder in folders for f in (tmp_path / folder).rglob("*.parquet") if b"double" in f.read_bytes()[-4000:] or b"vector" in f.read_bytes()[-4000:])
    assert folders and held == 0
