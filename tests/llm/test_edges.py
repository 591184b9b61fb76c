"""Awkward tables through every operator: nulls, empties, repeats, long texts, no rows, and columns that clash."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from deckloom.llm import html_text, mixing, nearest, packing, quality, simhash, substrings, token_counts, token_files, toxicity
from deckloom.llm.common import fresh, shared_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, and names of results.
CLASHES = "__k __th __spans __text __anchors __gone __h __least __u __n __source __cdf k n y held_out score times found fp component_id kept part start n_tokens"
NAMES = CLASHES.split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)


def rows():
    passage = " ".join(f"p{k}" for k in range(25))
    texts = [f"a first text {passage}", f"{passage} and a second one", None, "", " \n ", "same same", "same same", "bad zyx " * 3, "long " * 200_000]
    out = [(i, t, None if i == 2 else "s", *[c + str(i) for c in NAMES]) for i, t in enumerate(texts)]
    return [*out, out[1], (None, "no id", "s", *NAMES), (None, None, None, *[None] * len(NAMES))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 7), "x") for i in range(9)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, y string")


def by_row(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_fresh_names(docs):
    assert fresh(docs, "__k", "__K", "new") == ("__k_", "__K__", "new")


def test_toxicity(docs, labels):
    model = toxicity.train(docs, labels)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(rows()) and all(r.score is not None for r in scores)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in scores)
    assert set(by_row(kept)) <= set(by_row(docs))
    assert toxicity.score(docs.limit(0), model).count() == toxicity.drop_toxic(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).filter("predicted = 1").count() == 0
    same = {(r.score, r.predicted) for r in scores if r.doc_id in (2, 3, 4)}
    assert len(same) == 1  # null, empty and blank texts


def test_quality(docs, labels):
    model = quality.train(docs, labels)
    got = quality.judge(docs, model).collect()
    assert len(got) == len(rows()) and not any(r.kept for r in got if r.n_words < 50)
    assert [r.n_repeat_words for r in got if r.doc_id == 8] == [200_000] and len([r for r in got if r.doc_id == 1]) == 2
    assert quality.judge(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_near_duplicates(docs):
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and set(by_row(kept)) <= set(by_row(docs))
    ids = [r.doc_id for r in kept.collect()]
    # no words: 2, 3, 4 and a null id; equal texts: 5, 6; a row twice: 1; null ids stay
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 5, 7, 8] and ids.count(None) == 2
    assert simhash.first_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs).count() == len(rows())


def test_repeats(docs):
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows())
    text = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert text[0] == rows()[0][1] and text[1] == "and a second one" and text[2] is None and text[4] == " \n " and text[8] == "long"
    assert by_row(cut.drop("text")) == by_row(docs.drop("text"))
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_mixing(docs):
    mixed = mixing.mix(docs, mixing.size_tempered(docs), epochs=2.0)
    assert mixed.columns == [*docs.columns, "copy", "shuffle_key"]
    assert set(by_row(mixed.select(docs.columns))) <= set(by_row(docs))
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.size_tempered(docs), copy_col="K")


def test_tokens(spark, docs):
    for df, n in ((docs, len(rows())), (docs.limit(0), 0)):
        assert token_counts.count_tokens(df, BYTE).count() == n
        path = shared_path(spark, "edges")
        token_files.write_token_files(df, path, WORD)
        files = token_files.with_crc32(token_files.read_token_files(spark, path))
        pieces = packing.digest(packing.pack(df, WORD))
        assert files.count() == n
        assert (files.agg(F.sum("n_tokens")).first()[0] or 0) == (pieces.agg(F.sum("length")).first()[0] or 0)


def test_searches_and_pages(spark):
    rows = [(i, [float(i), 1.0], "a", "b") for i in range(20)] * 2 + [(3, [9.0, 9.0], "a", "b"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, shard string")
    got = nearest.nearest(df, F.col("vec_id") % 10 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 10) for k in (1, 2, 3)]
    pages = spark.createDataFrame([(None, None, None, "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(None, None, "", 0)]


def test_new_words_are_encoded_in_few_lines():
    import numpy as np
    import public_tokenizers

    from deckloom.llm.tokens import WordEncoder

    encoder, lines = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    library = encoder.tokenizer

    class Counted:
        def encode_batch(self, batch, **how):
            lines.extend(batch)
            return library.encode_batch(batch, **how)

    encoder.tokenizer = Counted()
    text = " ".join(f"w{k}x{k * 7919 % 1009}" for k in range(1000))
    (ids,) = encoder.encode([text.encode()])
    assert np.array_equal(ids, library.encode(text, add_special_tokens=False).ids) and len(lines) <= 4


def test_the_places_of_tokens_are_asked_for_only_where_words_are_not_letters_alone():
    import numpy as np
    import public_tokenizers

    from deckloom.llm.tokens import WordEncoder

    encoder, placed = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    library = encoder.tokenizer

    class Watched:
        def __init__(self, encoding):
            self.encoding, self.ids = encoding, encoding.ids

        @property
        def offsets(self):
            placed.append(len(self.ids))
            return self.encoding.offsets

    class Watching:
        def encode_batch(self, batch, **how):
            return [Watched(x) for x in library.encode_batch(batch, **how)]

    encoder.tokenizer = Watching()
    plain = " ".join(chr(97 + k % 26) * (k % 7 + 1) + "éabßxyzÉ"[k % 8] + "Word" for k in range(600))
    odd = "don't 's İx ﬁn ª µ क़ Ωa áb x1 Ab.,, c! é. \x1fz <|endoftext|>a ÿ 日本"
    for text in (plain, plain + " " + odd):
        placed.clear()
        (ids,) = encoder.encode([text.encode()])
        assert np.array_equal(ids, library.encode(text, add_special_tokens=False).ids)
        assert sum(placed) < 100 and (text != plain or not placed)
