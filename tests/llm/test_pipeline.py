"""The pipeline on small tables: every stage's rows against plain Python, and on awkward tables."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import oracle
import public_tokenizers
import pytest
from deckloom.llm import packing, registry
from deckloom.llm.common import stored
from test_operators import WORDS, check_packing, fingerprint_of, kept_words, reference_ids

import __spark_entry__

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, __copy string, __k string"


def planted():
    """Documents, some of them toxic, with copies, near copies and shared passages, and labels."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abdeghilmnorstu", k=rng.randrange(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choices(vocab, k=40))
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocab, k=rng.randrange(60, 200))
        if i % 4 == 0:
            for _ in range(12):
                words.insert(rng.randrange(len(words)), rng.choice(["zyxxo", "zyxxat", "qwvip", "qwvats"]))
        elif i % 4 == 1:
            words[30:30] = passage.split()
        elif i % 4 == 2 and i > 40:
            words = rows[i - 37][1].split() if rows[i - 37][1] and (i - 37) % 4 else words
            if i % 8 == 2:
                words = [*words[:-1], "other"]
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 4}", 0, "c", "k"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(240, None, None, None, None, None, None), (241, "", "en", "hot", 0, "c", "k"), rows[7], (None, "no id here", "en", "hot", 0, "c", "k")]
    return rows, labels


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_against_plain_python(spark, tmp_path):
    rows, labels = planted()
    sf = written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "packing"]

    def after(name):
        nonlocal docs
        docs = stored(stages[name](spark, docs, sf), name)
        return [tuple(r) for r in docs.collect()]

    clean = [r for r in rows if r[0] is None or r[0] >= 240 or r[0] % 4]
    got = after("toxicity")
    assert Counter(got) == Counter(clean)  # all planted documents go, and no other

    fp = {r[0]: fingerprint_of(r[1] or "") for r in clean if r[0] is not None}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if root[j] < root[i] and (fp[i] ^ fp[j]).bit_count() <= 4:
                    root[i], changed = root[j], True
    want = {r for r in clean if r[0] is None or root[r[0]] == r[0]}
    got = after("simhash_near_dedup")
    assert Counter(got) == Counter(want) and len(want) < len(clean) - 20

    words, kept = kept_words({-1 if r[0] is None else r[0]: r[1] or "" for r in want})
    before, got = {r[0]: r for r in want}, after("substring_dedup")
    assert len(got) == len(want) and sum(map(len, kept.values())) < sum(map(len, words.values())) - 500
    for r in got:
        i = -1 if r[0] is None else r[0]
        assert WORDS.findall(r[1] or "") == kept[i]
        assert r[4] == (None if r[1] is None else len(r[1])) and r[2:4] + r[5:] == before[r[0]][2:4] + before[r[0]][5:]
        assert r[1] == before[r[0]][1] or len(kept[i]) < len(words[i])

    sizes = Counter(r[3] for r in got)
    copies = Counter()
    for r in got:
        mean = sizes[r[3]] ** 0.5 / sum(n**0.5 for n in sizes.values()) * len(got) / sizes[r[3]]
        u = int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        term, total, k = np.exp(-mean), 0.0, 0
        while (total := total + term) <= u:
            k += 1
            term *= mean / k
        if k:
            copies[r] = k
    got = after("source_mixing")
    assert Counter(got) == copies

    pieces = stages["packing"](spark, docs, sf).collect()
    text = {r[0]: r[1] or "" for r in got}
    ids = {i: [*x, 1] for i, x in reference_ids(WORD, text).items()}
    number = Counter(r[0] for r in got)
    assert sum(p.length for p in pieces) == sum(len(ids[i]) * n for i, n in number.items())
    spans = defaultdict(list)
    for p in pieces:
        spans[p.doc_id].append((p.start, p.length))
    for i, n in number.items():
        seen = Counter(k for start, length in spans[i] for k in range(start, start + length))
        assert set(seen) == set(range(len(ids[i]))) and set(seen.values()) == {n}
    single = packing.digest(packing.pack(docs.dropDuplicates(["doc_id"]).filter("doc_id is not null"), WORD)).collect()
    check_packing(single, {i: x for i, x in ids.items() if i is not None}, 2048)
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] == sum(p.length for p in pieces)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)], [(5, "x y", None, None, None, None, None)] * 3])
def test_tables_with_no_rows_nulls_and_repeats(spark, tmp_path, rows):
    sf = written(spark, tmp_path, rows, [])
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert len({p.doc_id for p in pieces}) == len({r[0] for r in rows} if pieces else [])


def test_registered(spark):
    names = set(__spark_entry__.queries())
    assert {"pipeline", *registry.queries()} <= names and len([n for n in names if n.startswith("op")]) == 13


def test_twins_give_the_same_rows(spark):
    for name, sql in registry.oracle_sql().items():
        assert oracle.differences(spark, "/root/testdata/sf0.01", registry.queries()[name], sql) == []
