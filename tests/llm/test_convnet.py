"""The convolutional network against a plain loop over bytes, its gradient against differences, and awkward tables."""

import math
import random
import zlib

import numpy as np
import pytest

from deckloom.llm import convnet

RNG = random.Random(6)
TEXTS = [b"", b"a", "é ü".encode() * 3, bytes(RNG.randrange(256) for _ in range(133)), bytes(RNG.randrange(256) for _ in range(700)), b"word " * 64]


def plain(net, text):
    x = list(text) + [convnet.PADDING] * max(0, convnet.CHUNK + convnet.WIDTH - 1 - len(text))
    places = len(x) - convnet.WIDTH + 1
    z = []
    for i in range(places):
        window = np.concatenate([net.vectors[b] for b in x[i : i + convnet.WIDTH]]).astype(float)
        z.append(window @ net.filters + net.filter_bias)
    starts = list(range(0, places - convnet.CHUNK + 1, convnet.HALF))
    if starts[-1] + convnet.CHUNK < places:
        starts.append(places - convnet.CHUNK)
    most = np.zeros(convnet.HIDDEN)
    for s in starts:
        pooled = np.maximum(np.max(z[s : s + convnet.CHUNK], axis=0), 0)
        most = np.maximum(most, pooled @ net.units + net.unit_bias)
    return most @ net.last + net.bias[0]


def random_net(seed):
    return convnet.started(np.random.default_rng(seed))


@pytest.mark.parametrize("text", TEXTS)
def test_log_odds_are_a_plain_loops(text):
    assert abs(random_net(1).log_odds(text) - plain(random_net(1), text)) < 1e-4


def test_long_texts_are_scored_whole():
    """A passage that a unit answers to is found wherever it stands in a text of many blocks."""
    net, text = random_net(2), b"abcd" * 20_000
    assert abs(net.log_odds(text + b"x") - plain(net, text[:2000] + b"x")) < 1e-4
    passage = bytes(RNG.randrange(256) for _ in range(300))
    for at in (0, convnet.BLOCK - 150, 40_000, len(text)):
        assert abs(net.log_odds(text[:at] + passage + text[at:]) - net.log_odds(text)) > 1e-3


def test_gradient_is_that_of_differences():
    net = convnet.Net(*(w.astype(np.float64) for w in convnet.arrays_of(random_net(3))))
    text, y = TEXTS[4], 1.0
    grad = convnet.Net(*(np.zeros_like(w) for w in convnet.arrays_of(net)))
    convnet.add_gradient(net, grad, convnet.codes(text), y)
    rng = np.random.default_rng(0)
    for w, g in zip(convnet.arrays_of(net), convnet.arrays_of(grad), strict=True):
        for k in rng.choice(w.size, min(w.size, 12), replace=False):
            at, losses = np.unravel_index(k, w.shape), []
            for d in (1e-5, -1e-5):
                w[at] += d
                losses.append(math.log1p(math.exp(-plain(net, text))))
                w[at] -= d
            assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_fit_tells_texts_apart_and_puts_the_classes_ratio_into_the_bias():
    rng = random.Random(1)
    words = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randrange(5, 90))).encode() for _ in range(80)]
    texts = [w.replace(b" ", b"$$ ") if k % 2 else w for k, w in enumerate(words)]
    y = np.array([k % 2 == 0 for k in range(80)], float)
    even = convnet.fit(texts[:60], y[:60], np.ones(60), steps=60)
    assert all((even.probability(t) >= 0.5) == v for t, v in zip(texts[60:], y[60:]))
    more = convnet.fit(texts[:60], y[:60], np.where(y[:60] == 1, 3.0, 1.0), steps=60)
    assert abs(more.bias[0] - even.bias[0] - math.log(3)) < 1e-5


def test_awkward_tables(spark):
    rows = [(i, t, "s") for i, t in enumerate(["good text here", "b$d", None, "", "long " * 100_000, "good text here"])]
    rows += [rows[0], (None, "no id", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(6)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, y string")
    net = convnet.train(docs, labels, steps=3)
    got = convnet.score(docs, net).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows if i is not None}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert abs(r.score - net.probability((text[r.doc_id] or "").encode())) < 1e-9
    assert convnet.score(docs.limit(0), net).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1")):
        one = convnet.train(docs, none, steps=3)
        share = none.filter("quality = 1 AND crc32(binary(string(doc_id))) % 5 > 0").count()
        assert abs(one.probability(b"x") - (share + 0.5) / (share + 1.5)) < 1e-5


def test_the_sample_keeps_its_bounds_and_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(convnet, "TRAINING_ROW_BYTES", 50)
    monkeypatch.setattr(convnet, "TRAINING_BYTES", 200)
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(100)], "doc_id long, text string")
    got = convnet.training_texts(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"), {0: 30, 1: 30}).collect()
    for y in (0, 1):
        sizes = [len(r.text) for r in got if r.y == y]
        assert 1 < len(sizes) <= 30 and sum(sizes) <= 200 and max(sizes) <= 50
