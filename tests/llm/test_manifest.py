"""Merkle proofs and the audit of filters against plain Python, on awkward tables too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

import oracle
from deckloom.llm import filter_audit, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, place string, rank string, fails string, part string, mask string"


def rows():
    rng = random.Random(5)
    sources = ["many"] * 300 + ["some"] * 17 + ["one", "é", "z\U0001f600", "", None] + [f"s{k}" for k in range(20)]
    out = []
    for i, s in enumerate(sources):
        text = rng.choice(["Same Text", None, "", f"Some WORDS {i} é", "word " * 60, "a lot of $ " * 30, " ".join(map(str, range(i, i + 70))), " ".join(f"W{k}X" for k in range(60))])
        out.append((i * 3, text, rng.choice(["en", None]), s, rng.choice([None, i]), "x", None, "y", "z", "p", "m"))
    out += [out[4], out[4], (None, "no id", None, "many", 1, *"xyzpmq"), (None, "Same Text", None, None, None, *"xyzpmq"), (7 * 3, "other text of an id", "en", "many", 2, *"xyzpmq")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def plain_proofs(table):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in table:
        groups[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), doc_id, text, lang, n_chars))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, own, doc_id, text, lang, n_chars) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, k)]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            up = leaf(doc_id, s, lang, n_chars, text)
            for before, after in path:
                up = h(*before, up, *after)
            yield doc_id, own, trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), up, up == top[-1][0]


def test_proofs_are_plain_pythons(docs):
    got = sorted(map(repr, map(tuple, merkle.audit(docs).collect())))
    assert got == sorted(map(repr, plain_proofs(rows())))
    assert 0 < sum("False" in x for x in got) < len(got)


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17])
def test_proofs_of_small_tables(spark, count):
    for table in ([r for r in rows() if r[3] == "many" and r[0] is not None][:count], [(k, None, None, f"s{k}", None, *"abcdef") for k in range(count)]):
        assert sorted(map(repr, map(tuple, merkle.audit(spark.createDataFrame(table, SCHEMA)).collect()))) == sorted(map(repr, plain_proofs(table)))


def test_proofs_of_some_leaves_alone(docs):
    found = merkle.manifest(merkle.document_leaves(docs))
    asked = found.sources.places.filter("doc_id % 7 = 0")
    got = merkle.proofs(found, asked).select("doc_id", merkle.proof_digest(merkle.F.col("path")).alias("p")).collect()
    assert sorted((r.doc_id, r.p) for r in got) == sorted((x[0], x[4]) for x in plain_proofs(rows()) if x[0] is not None and x[0] % 7 == 0)


def plain_audit(table, labels):
    texts = defaultdict(list)
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    for doc_id, text, *_ in table:
        texts[text or ""] += [] if doc_id is None else [doc_id]
    parts = defaultdict(list)
    for doc_id, text, _, source, *_ in table:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > min(texts[text]),
        }
        parts[source or ""].append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    for part, docs_ in parts.items():
        done, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left, gone = docs_, []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in gone)
                left, gone = [d for d in left if f not in d[0]], gone + here
                shapley[f] += len(here)
                alone = sum(d[0] == {f} for d in docs_)
                done.append(("".join(order), step, len(left), len(here), redundant, alone, sum(d[1] for d in here), sum(d[2] for d in here)))
        yield from ((part, *x, shapley[x[0][x[1] - 1]]) for x in done)


def test_audit_is_the_filters_run_one_by_one(spark, docs):
    labels = [(3 * i, i % 2, int(i % 9 == 0)) for i in range(300)] + [(9, 1, 0), (9, None, 1), (None, 1, 1), (12, None, None)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows(), labels))


def test_audit_of_no_documents(spark, docs):
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_removal_steps_are_minima_over_failing_filters():
    orders = np.array(list(permutations(range(4))))
    fails = (np.arange(16)[:, None] >> np.arange(4)) & 1 == 1
    got = filter_audit.removal_steps(fails, filter_audit.positions(orders))
    for m in range(16):
        for p, order in enumerate(orders):
            assert got[m, p] == next((s for s, f in enumerate(order) if fails[m, f]), filter_audit.NEVER)


@pytest.mark.parametrize("operator", [merkle, filter_audit])
def test_same_rows_as_sql(spark, operator):
    assert oracle.differences(spark, SF, operator.query, operator.SQL) == []
