"""The registered queries over the smallest tables: columns, keys, checksums and held-out rows, from a plain reading of the contract."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recallgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts):
    got = run(spark, "op1_minimax_shards")
    assert len(got) == len(texts) and got.grown_shard.isna().all() and (got.law == "bytes").all()
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, crc(raw))
    assert got.shard.between(0, 15).all() and got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    shard_of = got.groupby(got.doc_id.map(texts)).shard.nunique()
    assert (shard_of == 1).all()


def test_op2(spark, texts):
    got = run(spark, "op2_avi_motion_jpeg")
    features = {}
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), crc(payload[-32:]))
        assert features.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len(got) == len(texts)


def test_op4(spark, texts):
    got = run(spark, "op4_class_kneser_ney")
    assert set(got.doc_id) == set(texts) and got.score.between(0, 1).all()
    assert (got.held_out == [crc(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()


def test_op5(spark, texts):
    got = run(spark, "op5_word_bpe")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got.itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_op6(spark, texts):
    got = run(spark, "op6_monotone_packing")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, g in got.groupby("doc_id"):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    full = got.groupby("sequence_id").length.sum()
    assert set(got.doc_id) == set(texts) and full.max() <= 2048
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()


def test_op7(spark, texts):
    got = run(spark, "op7_suffix_sort").set_index("doc_id")
    times = Counter(t[i : i + 400] for t in (x.encode() for x in texts.values()) for i in range(len(t) - 399))
    for doc, text in texts.items():
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if times[raw[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        r = got.loc[doc]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), int(gone.sum()), sha(kept))
        assert r.kept_text == kept.decode("utf-8", "replace") or "�" in r.kept_text


def test_op10(spark, texts):
    got = run(spark, "op10_kneser_ney")
    split = __import__("re").compile(r"[^\x20\x09-\x0D]+")
    lower = {i: i + 32 for i in range(65, 91)}
    tokens = {i: [*split.findall(t.translate(lower)), None] for i, t in texts.items()}
    known = Counter(w for i, t in tokens.items() if crc(str(i).encode()) % 10 for w in t)
    n = sum(known.values())
    for r in got.itertuples():
        t = tokens[r.doc_id]
        base = sum(np.log10((known[w] + 0.1) / (n + 0.1 * (len(known) + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in known for w in t), n, crc(str(r.doc_id).encode()) % 10 == 0)
        assert np.isclose(r.base_score, base, rtol=1e-9) and r.score < 0
