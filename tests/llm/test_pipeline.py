"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(plain) for _ in range(n))

    rows = [(i, prose(rng.randrange(40, 200))) for i in range(300)]
    rows = [(i, t + " zorrak zorrik" if i % 6 == 0 else t) for i, t in rows]
    passage = prose(120)
    rows += [(1000, rows[1][1]), (1001, rows[2][1].upper()), (1002, rows[3][1] + " more"), (1003, prose(50) + passage), (1004, prose(60) + passage), (1005, ""), (1006, None), (None, prose(30))]
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 300) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        kept[name] = docs.toPandas()
        if k < 4:
            assert docs.columns == columns
    toxic = set(kept["toxicity"].doc_id.dropna())
    assert len([i for i in toxic if i < 300 and i % 6 == 0]) <= 2 and len([i for i in toxic if i < 300 and i % 6]) >= 245
    exact = set(kept["exact dedup"].doc_id.dropna())
    assert {1000, 1001} <= exact and not {1, 2} & exact
    near = set(kept["MinHash near-dedup"].doc_id.dropna())
    assert 3 in near and 1002 not in near
    cut = kept["suffix-array dedup"].set_index("doc_id")
    assert len(cut.text[1003]) < 400 and cut.n_chars[1003] == len(cut.text[1003])
    assert kept["packing"].length.max() <= 2048


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pieces(df):
        """Each document's tokens by checksum of its pieces in order; where windows end depends on the order of rows."""
        out = {}
        for r in df.select(*columns).collect():
            out.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        return {i: (sum(n for _, n, _ in p), p[0][2]) for i, p in out.items()}

    got, want = pieces(corpus_pipeline.run(spark, folder)), pieces(docs)
    assert got == want and len(got) > 200 and all(a == b for a, b in got.values())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_edges_of_each_stage(spark, folder, name):
    """Columns with the operators' own names, repeated rows, nulls, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clashing = ("figures", "score", "predicted", "kept", "n_removed", "n_spans", "n_bytes", "kept_bytes", "node", "root", "component_id", "size")
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in clashing)
    text = "one two three four five six seven " * 9
    rows = [(1, text), (1, text), (2, None), (None, "a text without an id"), (None, None), (3, ""), (4, "word " * 3000), (5, text.upper())]
    docs = spark.createDataFrame([(i, t, "xx", *(f"own {c}" for c in clashing)) for i, t in rows], schema)
    got = stage(spark, docs, folder)
    if name == "packing":
        tokens = {r.doc_id: r.doc_tokens for r in got.collect()}
        assert set(tokens) == {1, 2, 3, 4, 5, None} and tokens[2] == tokens[3] == 1
    else:
        assert got.columns == docs.columns
        kept = got.collect()
        assert kept and all(r[c] == f"own {c}" for r in kept for c in clashing)
        count = {"toxicity": len(rows), "exact dedup": 4, "MinHash near-dedup": 6, "suffix-array dedup": len(rows)}[name]
        assert len(kept) == count, [(r.doc_id, (r.text or "")[:20]) for r in kept]
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_passages_of_over_50_words_go(spark, folder):
    """Passages of 51 to 65 words, all under 400 bytes, between other words or run into them; 48 words stay."""
    rng = random.Random(51)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(n))

    passages = [prose(n) for n in range(51, 66)]
    short = prose(48)
    assert max(len(p) for p in passages) < 400
    rows = [(2 * k + i, prose(60) + sep + p + sep + prose(70)) for k, p in enumerate(passages) for i, sep in enumerate((" ", "\n" if k % 2 else ""))]
    rows += [(100, prose(60) + " " + short + " " + prose(30)), (101, prose(40) + " " + short)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, folder).collect()}
    whole = dict(rows)
    for k, p in enumerate(passages):
        middle = " ".join(p.split()[1:-1])
        assert all(middle not in got[i].text and len(got[i].text) <= len(whole[i]) - len(middle) and got[i].n_chars == len(got[i].text) for i in (2 * k, 2 * k + 1))
    assert all(got[i].text == whole[i] for i in (100, 101))
