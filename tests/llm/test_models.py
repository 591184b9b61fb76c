"""The two classifiers against plain Python: n-grams taken one by one, and a dense logistic regression."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from deckloom.llm import quality, toxicity

M64 = (1 << 64) - 1


def mix64(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def char_bucket(gram):
    h = 0x811C9DC5
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
    h ^= len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h >> 12


def grams(text, orders):
    return {char_bucket(text[i : i + n]) for n in orders for i in range(len(text) - n + 1)}


def toxic_features(text):
    return grams(re.sub(r"[^a-z\x80-\U0010ffff]+", " ", f" {(text or '').lower()} "), toxicity.ORDERS)


def quality_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [int.from_bytes(xxhash.xxh3_128_digest(w.encode())[:8], "big") for w in words]
    pairs = [mix64((a * 0x9E3779B97F4A7C15 + b) & M64) for a, b in zip(h, h[1:])]
    return {mix64(x) >> 44 for x in h + pairs} | grams(" ".join((text or "").split()), quality.CHAR_ORDERS)


def dense_fit(rows, y, log_count_ratio, rate, even, steps=40):
    """A function from features to the log-odds."""
    columns = {f: k for k, f in enumerate(sorted(set().union(*rows)))}
    x = np.zeros((len(rows), len(columns)))
    for i, r in enumerate(rows):
        x[i, [columns[f] for f in r]] = 1
    scale = np.ones(len(columns))
    if log_count_ratio:
        share = [(x[y == v].sum(0) + 1) / ((y == v).sum() + 2) for v in (1, 0)]
        scale = np.log(share[0] / share[1])
    x = x * scale / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** even
    weight /= weight.sum()
    w, b, m, v = np.zeros(len(columns)), 0.0, np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for step in range(1, steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        grad = np.append(x.T @ off + 1e-6 * w, off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return lambda found: b + sum(w[columns[f]] * scale[columns[f]] for f in found if f in columns) / max(1, len(found)) ** 0.5


def small(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeéжü", k=rng.randrange(2, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 25)) + (["zyq", "Zyq!"] * 2 if i % 3 == 0 else []))) for i in range(90)]
    rows += [(90, ""), (91, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return dict(rows), docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic", "int(doc_id % 3 > 0) AS quality")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_scores_are_a_plain_models(spark):
    texts, docs, labels = small(spark)
    ids = [i for i in texts if not held(i)]
    y = np.array([float(i % 3 == 0) for i in ids])
    rows = [toxic_features(texts[i]) for i in ids]
    log_odds = dense_fit(rows, y, True, 1.0, 0.5)
    of = toxicity.features()
    assert all(set(of(t or "").tolist()) == toxic_features(t) for t in texts.values())
    for r in toxicity.score(docs, toxicity.train(docs, labels)).collect():
        assert abs(r.score - 1 / (1 + math.exp(-log_odds(toxic_features(texts[r.doc_id]))))) < 2e-3


def test_quality_probabilities_are_a_plain_models(spark):
    texts, docs, labels = small(spark)
    of = quality.features()
    assert all(set(of(t or "").tolist()) == quality_features(t) for t in texts.values())
    ids = [i for i in texts if not held(i)]
    log_odds = dense_fit([quality_features(texts[i]) for i in ids], np.array([float(i % 3 > 0) for i in ids]), False, 0.3, 0.0)
    left = [i for i in texts if held(i)]
    z, y = np.array([log_odds(quality_features(texts[i])) for i in left]), np.array([i % 3 > 0 for i in left])
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(200_000):  # the same loss by small plain steps
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        slope, shift = slope - 0.01 * ((p - target) @ z + 1e-3 * (slope - 1)) / len(z), shift - 0.01 * ((p - target).sum() + 1e-3 * shift) / len(z)
    for r in quality.judge(docs, quality.train(docs, labels)).collect():
        assert abs(r.probability - 1 / (1 + math.exp(-(slope * log_odds(quality_features(texts[r.doc_id])) + shift)))) < 1e-2


def test_long_texts_are_scored_whole():
    """Blocks of a long text give the n-grams of the whole, those across the blocks' edges too."""
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij ", k=2_200_000))
    from deckloom.llm import ngrams

    whole = ngrams.code_points(text)
    got = np.unique(np.concatenate(list(ngrams.char_buckets(whole, (4, 6)))))
    near = text[ngrams.BLOCK_CHARS - 8 : ngrams.BLOCK_CHARS + 8]
    assert grams(near, (4, 6)) <= set(got.tolist())
    assert Counter(map(len, ngrams.char_buckets(whole, (4,)))).total() == 3
    assert sum(map(len, ngrams.char_buckets(whole, (4,)))) == len(text) - 3
