"""The recurrent network: derivatives, whole texts, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleweave.llm import recurrent, registry, toxicity

SF = "/root/testdata/sf0.1"


def slice_of(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_words_and_their_runs():
    v, which, owner, starts = recurrent.read_words(*slice_of(["The cat, the CAT!", "", "é-é"]))
    assert owner.tolist() == [0, 0, 0, 0, 2, 2] and starts.tolist() == [0, 4, 9, 13, 17, 20]
    assert which[0] == which[2] and which[1] == which[3] and which[4] == which[5] and len(v.word) == 3
    # a word of n bytes has n + 3 - k runs of k bytes, marks included
    assert np.diff(v.at)[which[0]] == 3 + 2 + 1 and np.diff(v.at)[which[4]] == 2 + 1


def test_derivatives_match_differences(monkeypatch):
    net = recurrent.Network.new(3)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    monkeypatch.setattr(np, "float32", np.float64)
    v, which, _, _ = recurrent.read_words(*slice_of(["ab cd ab ef gh ij cd kl mn op"]))
    tokens = which[[[0, 1, 2, 3, 4], [5, 6, 7, 7, 7], [8, 9, 0, 1, 1]]]
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 1, 0]], bool)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(v, tokens, mask, label, weight)
    rng = np.random.default_rng(1)
    for name, w in net.weights.items():
        near = np.flatnonzero(np.abs(g[name].ravel()) > 1e-7)
        for i in rng.choice(near, min(6, len(near)), replace=False):
            old = w.ravel()[i]
            loss = []
            for step in (1e-5, -1e-5):
                w.ravel()[i] = old + step
                loss.append(net.gradients(v, tokens, mask, label, weight)[0])
            w.ravel()[i] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[name].ravel()[i]) < 1e-6, name


def test_windows_cover_all_words():
    for n in [*range(0, 700, 7), 128, 129, 224, 225]:
        own = toxicity.windows(n)
        assert sorted({w for a, k in own for w in range(a, a + k)}) == list(range(n))
        assert all(k == toxicity.WINDOW for _, k in own[:-1]) and all(b[0] - a[0] == toxicity.STRIDE for a, b in zip(own, own[1:]))
        text, first, length = toxicity._of_texts(np.zeros(n, np.int64), 1)
        assert list(zip(first.tolist(), length.tolist())) == own


def test_long_texts_are_read_whole(monkeypatch):
    net, rng = recurrent.Network.new(1), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12))) for _ in range(n)) for n in (3000, 5, 129)] + ["", None, "!! ?", "x" * 9000 + " y " + "z" * 9000]
    whole, n = toxicity.score_texts(net, pa.array(texts))
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    pieces, m = toxicity.score_texts(net, pa.array(texts))
    assert n.tolist() == m.tolist() == [31, 1, 2, 0, 0, 0, 1]
    np.testing.assert_allclose(whole, pieces, atol=1e-4)


def test_long_sequences_of_short_texts_agree():
    net, rng = recurrent.Network.new(1), random.Random(4)
    texts = [" ".join(rng.choice(["ab", "cd", "efg"]) for _ in range(rng.randrange(400))) for _ in range(40)]
    together, _ = toxicity.score_texts(net, pa.array(texts))
    alone = [toxicity.score_texts(net, pa.array([t]))[0][0] for t in texts]
    np.testing.assert_allclose(together, alone, atol=1e-4)


@pytest.fixture(scope="module")
def scored(spark):
    out = registry.op12_recurrent_toxicity(spark, SF)
    return out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()


def test_held_out_documents(scored):
    held = [r for r in scored if r.held_out]
    toxic, clean = ([r for r in held if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    above = sum(t.score > c.score for t in toxic for c in clean) / len(toxic) / len(clean)
    assert above > 0.93


def test_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, score string, top string"
    rows = [(i, ("you idiot fool" if i % 3 == 0 else "fine day sun") + f" {i}", "en", "x", "y") for i in range(90)] + [(None, "x", None, None, None), (100, None, None, None, None), (101, "", None, None, None), (0, "other text", None, None, None), (0, "other text", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (4, None), (None, 1), (777, 1)], "doc_id long, toxic int")
    held = F.col("doc_id") % 4 == 2
    got = toxicity.score_documents(docs, labels, held)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and len({r.score for r in out if r.doc_id in (100, 101)}) == 1
    known = [r for r in out if r.doc_id is not None and 0 < r.doc_id < 90 and r.held_out]
    assert min(r.score for r in known if r.doc_id % 3 == 0) > max(r.score for r in known if r.doc_id % 3)
    assert toxicity.score_documents(docs.limit(0), labels, held).isEmpty()
    flat = {r.score for r in toxicity.score_documents(docs, labels.where("toxic = 0"), held).collect()}
    none = {r.score for r in toxicity.score_documents(docs, labels.limit(0), held).collect()}
    assert len(flat) == 1 and 0 < flat.pop() < 0.05 and none == {0.5}
