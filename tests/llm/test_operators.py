"""The operators against brute force, and on awkward rows: nulls, empty and very long texts, ties, repeats, no rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deckloom.llm import html_text, linear, mixing, nearest, packing, quality, simhash, substrings, token_counts, token_files, tokens, toxicity
from deckloom.llm.common import shared_path
from deckloom.llm.tokens import ChunkLengths, WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, k int, pos string, __other int"


def awkward(n=60, seed=1):
    """Rows with shared passages, copies, a hot source, nulls, empty and very long texts."""
    rng = random.Random(seed)
    vocab = [a + b for a in ("ba", "co", "du", "Ė", "x'") for b in ("ra", "lo", "9", "é,", "n.", "t's")]
    shared = [" ".join(rng.choices(vocab, k=35)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 60)))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), rng.choice(shared))
        sep = rng.choice([" ", "\n", "\t ", "\n\n"])
        rows.append((i, sep.join(parts), "hot" if i % 3 else f"s{i % 5}", i, "p", None))
    rows += [(n, None, None, 0, None, 1), (n + 1, "", "hot", 0, None, 1), (n + 2, " \n\t ", "hot", 0, None, 1)]
    rows += [(n + 3, rows[4][1], "hot", 0, None, 1), (n + 4, rows[4][1], "hot", 0, None, 1), (n + 5, "a b c", "hot", 0, None, 1)]
    rows += [(n + 6, "word " * 30_000 + " \n\n end <|endoftext|> x", "long", 0, None, 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows and ids, and null ids."""
    rows = awkward(12)
    return spark.createDataFrame([*rows, *rows[:6], (3, "another text of one two three", "hot", 0, None, 1), (None, "no id", "hot", 0, None, 1), (None, None, None, 0, None, 1)], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in awkward()}


def reference_ids(path, all_texts):
    tokenizer = Tokenizer.from_file(path)
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in all_texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("cache_bytes", [tokens.CACHE_BYTES, 100_000])
def test_word_cache_gives_the_librarys_ids(monkeypatch, cache_bytes):
    """Whatever a full cache drops; slices of text are so small that the small cache is full many times."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", cache_bytes)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 2000)
    rng, tokenizer, words = random.Random(3), Tokenizer.from_file(WORD), WordEncoder(WORD)
    marks = ["a", "B", "é", "É", "İ", "Σ", "ς", "é", "'s", "'", "9", "中", "…", "—", "!", ",", "#", " ", " ", "\x1c", " ", "\n", "\t", "\x0b"]
    marks += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "🙂", "‍", "ﬁ"]
    cases = ["".join(rng.choices(marks, k=rng.randrange(0, 25))) for _ in range(3000)]
    got = list(words.encode(c.encode() for c in cases))
    for case, ids in zip(cases, got, strict=True):
        assert ids.tolist() == tokenizer.encode(case, add_special_tokens=False).ids, repr(case)


def test_chunk_counts_are_the_librarys():
    rng, tokenizer, own = random.Random(4), Tokenizer.from_file(BYTE), ChunkLengths(BYTE, {})
    marks = ["a", "B", "é", "'s", "'ll", "9", "中", "…", "!", ",", " ", " ", "\x1c", "\x85", "　", " ", "  ", "\n", "\r\n", "\t", "\x0b", "<|endoftext|>", "🙂"]
    for _ in range(3000):
        case = "".join(rng.choices(marks, k=rng.randrange(0, 25)))
        assert own.count(case.encode()) == len(tokenizer.encode(case, add_special_tokens=False).ids), repr(case)


def test_token_counts(docs, none, repeated):
    want, all_texts = reference_ids(BYTE, texts()), texts()
    rows = token_counts.count_tokens(docs, BYTE).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(all_texts[r.doc_id].encode()), len(want[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 512)
    assert token_counts.count_tokens(none, BYTE).count() == 0
    assert token_counts.count_tokens(repeated, BYTE).count() == repeated.count()


def test_token_files_round_trip(spark, docs, none, repeated):
    want = reference_ids(WORD, texts())
    path = shared_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORD)
    back = token_files.read_token_files(spark, path)
    rows = {r.doc_id: r for r in back.collect()}
    at = 0
    for i in sorted(want):
        assert (rows[i].token_ids, rows[i].start, rows[i].n_tokens) == ([*want[i], 1], at, len(want[i]) + 1)
        at += len(want[i]) + 1
    assert {r.doc_id: r.ids_crc32 for r in token_files.with_crc32(back).collect()} == {i: crc([*x, 1]) for i, x in want.items()}
    for other in (none, repeated):
        path = shared_path(spark, "test-files")
        token_files.write_token_files(other, path, WORD)
        assert token_files.read_token_files(spark, path).count() == other.count()


def scanned(df):
    """Rows that the scan of the token files gives."""
    assert df.count() >= 0
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size()) if "orc" in leaves.apply(k).nodeName()]
    return sum(x.metrics().apply("numOutputRows").value() for x in scans)


def test_token_files_have_indexes_that_prune(spark):
    """Row groups of 1000 rows are skipped by their bounds, and by Bloom filters where the bounds don't tell."""
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('some words ', id) AS text").coalesce(1)
    path = shared_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORD, stripe_bytes=1 << 16)
    files = sorted(Path(path, "ids").glob("*.orc"))
    orc = pyarrow.orc.ORCFile(files[0])
    assert orc.row_index_stride == 1000 and sum(pyarrow.orc.ORCFile(f).nstripes for f in files) >= len(files)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        back = token_files.read_token_files(spark, path)
        assert scanned(back) == 20_000
        one = back.filter("doc_id = 4242")
        assert one.count() == 1 and 0 < scanned(one) <= 1000  # the other row groups are out of its bounds
        assert scanned(back.filter("doc_id = 4243")) == 0  # inside a row group's bounds, but not in its Bloom filter
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_token_file_offsets_over_blocks_of_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BLOCK", 2)
    monkeypatch.setattr(token_files, "BROADCAST_FILES", 0)
    path = shared_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORD)
    at = 0
    for r in sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.doc_id):
        assert r.start == at
        at += r.n_tokens


def check_packing(rows, want, capacity):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        spans = sorted((r.start, r.length) for r in pieces[i])
        assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) == len(ids)
    for inside in windows.values():
        spans = sorted((r.offset, r.length) for r in inside)
        assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
        used = sum(n for _, n in spans)
        assert used == capacity or used < capacity and used & (used - 1) == 0


def test_packing(docs, none, repeated):
    want = {i: [*x, 1] for i, x in reference_ids(WORD, texts()).items()}
    for capacity in (2048, 64, 50):
        check_packing(packing.digest(packing.pack(docs, WORD, capacity)).collect(), want, capacity)
    assert packing.pack(none, WORD).count() == 0
    total = packing.pack(repeated, WORD).agg(F.sum("length")).first()[0]
    assert total == sum(len(token_ids) + 1 for token_ids in reference_ids(WORD, dict(enumerate(r.text or "" for r in repeated.collect()))).values())


def test_level_rule_picks_the_least_sum_of_squares():
    rng, packer = random.Random(5), packing.LevelPacker(32)
    for _ in range(500):
        size = rng.randrange(1, 32)
        before = packer.counts.copy()

        def cost(level, size=size, before=before):
            after = before.copy()
            after[level] -= level > 0
            if level + size < 32:
                after[level + size] += 1
            return int((after[1:32] ** 2).sum())

        able = [0, *[h for h in range(1, 33 - size) if before[h]]]
        assert cost(packer.level_for(size)) == min(map(cost, able))
        packer.place((0, 0, size, np.zeros(size, np.uint32)))


def test_difference_cover_meets_every_pair_of_positions():
    cover = set(substrings.COVER)
    for i, j in itertools.product(range(substrings.PERIOD), repeat=2):
        assert any((i + k) % substrings.PERIOD in cover and (j + k) % substrings.PERIOD in cover for k in range(substrings.PERIOD))


def kept_words(all_texts, window=20):
    words = {i: WORDS.findall(t) for i, t in all_texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), (i, j))
    kept = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (i, j):
                gone[j : j + window] = [True] * window
        kept[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return words, kept


def test_substring_removal(docs, none, repeated):
    words, kept = kept_words(texts())
    assert sum(map(len, kept.values())) < sum(map(len, words.values()))
    for r in substrings.removal_digest(docs).collect():
        w, k = words[r.doc_id], kept[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(w), len(w) - len(k)) and r.kept_sha256 == hashlib.sha256(" ".join(k).encode()).hexdigest()
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert WORDS.findall(r.text or "") == kept[r.doc_id]
    assert substrings.removal_digest(none).count() == 0 and substrings.remove_repeats(none).count() == 0
    rows = [tuple(r) for r in substrings.removal_digest(repeated).collect()]
    assert len(rows) == repeated.count()
    by_row = defaultdict(set)
    for r, n in Counter(rows).items():
        by_row[r[0]].add(r[1:])
    assert all(len(v) == 1 for i, v in by_row.items() if i not in (3, None))


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    """Words of 1024 to 4096 letters that differ, but have the same polynomial hash modulo 2**64 for every base."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        for flip in (0, 1):
            words = [f"w{j}" for j in range(40)]
            words[::3] = [thue_morse(n, *("ba" if flip else "ab"))] * len(words[::3])
            rows.append((2 * k + flip, " ".join(words)))
            rows.append((100 + 2 * k + flip, " ".join([thue_morse(n, *(("ab", "ba")[(j + flip) % 2])) + f" x{j} y" for j in range(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words, kept = kept_words(dict(rows))
    for r in substrings.removal_digest(df).collect():
        assert r.n_removed == len(words[r.doc_id]) - len(kept[r.doc_id])
    for i, t in rows:
        n = Counter(tuple(words[i][k : k + 3]) for k in range(len(words[i]) - 2))
        again = {k + j for k in range(len(words[i]) - 2) if n[tuple(words[i][k : k + 3])] > 1 for j in range(3)}
        assert quality.base_counts(t.encode(), quality.all_word_hashes(t.encode()))[4] == len(again)


def test_hot_passages_over_many_batches(spark):
    """A passage that most documents hold, in batches so small that tasks meet it many times."""
    rng = random.Random(12)
    passage = [f"p{j}" for j in range(33)]
    rows = []
    for i in range(400):
        words = [f"u{i}_{j}" for j in range(rng.randrange(0, 6))]
        rows.append((i * 7 % 400, " ".join(words + passage * rng.choice([0, 1, 1, 2]) + words[:2] + passage[: rng.randrange(15, 33)])))
    words, kept = kept_words(dict(rows))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = substrings.removal_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept[r.doc_id]).encode()).hexdigest()


def fingerprint_of(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none, repeated):
    fp = {i: fingerprint_of(t) for i, t in texts().items()}
    up = {i: i for i in fp}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(fp)
    for r in rows:
        assert (r.fp % (1 << 64), r.component_id) == (fp[r.doc_id], root(r.doc_id))
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == {root(i) for i in fp}
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).count() == 0
    assert simhash.near_duplicates(repeated).count() == repeated.count()
    named = [r.doc_id for r in simhash.first_of_each(repeated).collect() if r.doc_id is not None]
    assert len(named) == len(set(named))


def test_chains_and_crowded_values(spark, monkeypatch):
    """Fingerprints that form long chains, in tiles so small that a shared value is dealt to many tasks."""
    monkeypatch.setattr(simhash, "DEALT_TILE", 8)
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(6)
    fps, chain = [], 0
    for _ in range(3):
        chain = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.choice([1, 4, 5])):
                chain ^= 1 << b
            fps.append(chain)
    fps += [rng.getrandbits(8) for _ in range(40)]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "HUB", 5)
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    found = [{r.node: r.root for r in simhash.components(simhash.links(reps, n=n)).collect()} for n in (len(fps), 1 << 25)]
    got = found[0]
    assert found[0] == found[1]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert [got.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_keys_and_tiles():
    """Fingerprints within the radius share a key, whatever the number of ranges; few share one by chance."""
    rng, sizes = random.Random(11), []
    for n in (1000, 1 << 20, 1 << 30, 1 << 38):
        masks = simhash.key_masks(n)
        sizes.append((len(masks), min(m.bit_count() for m in masks)))
        assert n <= simhash.EXPECTED << sizes[-1][1]
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)
    assert sizes == [(5, 12), (15, 20), (35, 27), (70, 32)]
    fp = np.array([rng.getrandbits(64) for _ in range(4096)] + [0, 1, (1 << 64) - 1], np.uint64)
    pop = np.sort(np.bitwise_count(fp).astype(np.int16))
    tiles = -(-len(fp) // simhash.TILE)
    compared = len(list(simhash.tile_pairs(pop, 4)))
    assert tiles <= compared < 0.8 * tiles * (tiles + 1) / 2
    i, j = simhash.group_links(fp, np.zeros(len(fp), np.int32), np.array([0, len(fp)]), 4)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} == {(4096, 4097)}


def test_nearest(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 24))
    x = (centres[rng.integers(0, 6, 900)] + 0.5 * rng.normal(size=(900, 24))).astype(np.float32)
    x[300:400] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * 24, 1), (5200, [float("nan")] * 24, 1), (5300, [1.0] * 5, 1), (None, x[0].tolist(), 1), (5400, [None, *x[0].tolist()[1:]], 1)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>, score int").repartition(4)
    found = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=250, rerank=60).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    assert set(found) == set(range(0, 900, 20))
    for q, got in found.items():
        away = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(900), away)) if i != q][:10]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(g[2] - away[g[1]]) < 1e-12 for g in got)
        hits += len(set(want) & {g[1] for g in got})
        total += 10
    assert hits / total >= 0.95
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest.nearest(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header class=site><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div id=cookie-notice>We use cookies, and more cookies, for you.</div>
<div class=wrap><main><article><h1>Title &amp; more</h1><p><b>Lead text, with commas, that goes on for a while&nbsp;here.<br><p>Second
paragraph, with   spaces, and quite some words in it.</p><ul><li>one<li>two <i>bits</i></ul><script>var x="</p>";</script>
<div class="ad">Buy, buy, buy this thing today!</div><form><input><button>Send</button></form>
<section class="comments"><p>I, for one, liked this article a lot, really.</p></section></article></main>
<aside><p>Side bar, which is long, with commas, and so on, and on.</p></aside></div><footer><p>&copy; all, rights, reserved, here.</p></footer></body></html>"""
MAIN = "Title & more\n\nLead text, with commas, that goes on for a while here.\n\nSecond paragraph, with spaces, and quite some words in it.\n\none\n\ntwo bits"


def test_html(spark):
    deep = "<div>" * 3000 + "deep text, that goes on, for a while"
    rows = [(1, "u", PAGE.format(), 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "just text & more", 0), (5, "u", deep, 0), (None, "u", "<p>x</p" * 5, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == MAIN and got[2].text == got[3].text == "" and got[4].text == "just text & more"
    assert got[5].text == "deep text, that goes on, for a while" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def labelled(spark, n=700):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abdeghilmnorstu", k=rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(30, 200))
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["zyxxo", "zyxxat", "qwvip"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "no id at all")]
    labels += [(n, None, 0), (n + 9, 1, 1), (None, 1, 1), (0, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(702) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id < 700) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels))
    assert kept.count() == sum(1 - r.predicted for r in rows)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}


def test_quality(spark, docs, none):
    labelled_docs, labels = labelled(spark)
    model = quality.train(labelled_docs, labels)
    rows = quality.judge(labelled_docs, model).collect()
    good = [r for r in rows if r.doc_id is not None and r.doc_id < 700]
    assert sum((r.probability >= 0.5) == (r.doc_id % 3 > 0) for r in good) >= 0.97 * len(good)
    for r in quality.judge(docs, model).collect():
        t = texts()[r.doc_id]
        w = WORDS.findall(t)
        runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r.kept == (not r.base_failed and r.probability >= 0.5)
    assert quality.judge(none, model).count() == 0


def test_mixing(spark, docs, none, repeated):
    weights = mixing.size_tempered(docs)
    rows = mixing.mix(docs, weights, epochs=3.0).collect()
    means = {r.source: r for r in mixing.repetition(docs, weights, 3.0).collect()}
    n = Counter(r.doc_id for r in rows)
    for r in docs.collect():
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        mean, term, total, k = means[r.source].mean, np.exp(-means[r.source].mean), 0.0, 0
        while (total := total + term) <= u:
            k += 1
            term *= mean / k
        assert n[r.doc_id] == k
    assert abs(sum(m.mean * c for m, c in ((means[s], c) for s, c in Counter(r.source for r in docs.collect()).items())) - 3 * docs.count()) < 1e-6
    assert mixing.mix(none, mixing.size_tempered(none)).count() == 0
    assert mixing.mix(repeated, mixing.size_tempered(repeated)).count() >= 0
    only = spark.createDataFrame([("hot", 1.0), ("absent", 5.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, only).collect()} == {"hot"}


def test_linear_model_without_both_classes_is_the_prior():
    rows = [np.array([1, 2], np.int32)] * 3
    assert linear.fit(rows, np.ones(3), True).probability(rows[0]) > 0.5
    assert linear.fit([], np.zeros(0), True).probability(rows[0]) < 0.5


def sampled(*args):
    rows = linear.labelled_sample(*args).collect()
    return linear.Rows([bytes(r.found) for r in rows]), np.array([float(r.y) for r in rows]), np.array([r.times for r in rows])


def test_bounds_on_rows_leave_the_ratio_of_the_classes(spark, monkeypatch):
    """Texts that tell nothing are as likely to be good as the whole table says, however few rows of a class are used."""
    docs = spark.range(1400).selectExpr("id AS doc_id", "'the same few words' AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 7 > 0) AS quality", "int(doc_id % 7 = 0) AS toxic")
    held = [i for i in range(1400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows, y, times = sampled(docs, labels, "quality", quality.features, {1: 60, 0: 50})
    good = sum(i % 7 > 0 for i in range(1400)) - sum(i % 7 > 0 for i in held)
    assert len(rows) == 110 and round(times @ y) == good and round(times.sum()) == 1400 - len(held)
    monkeypatch.setattr(quality, "TRAINING_ROWS", {1: 50, 0: 50})
    monkeypatch.setattr(quality, "CALIBRATION_ROWS", {1: 20, 0: 20})
    share = sum(i % 7 > 0 for i in held) / len(held)
    for model in (quality.train(docs, labels), linear.fit(rows, y, False, times=times)):
        assert abs(model.probability(rows[0]) - share) < 0.05
    same = [toxicity.train(docs, labels, most).probability(np.arange(9)) for most in ({1: 50, 0: 50}, {1: 5000, 0: 5000})]
    assert abs(same[0] - same[1]) < 0.05


def test_calibration_of_well_parted_rows_does_not_run_away():
    """Full Newton steps from a slope of one overshoot on such margins, to slopes of many millions."""
    rng = np.random.default_rng(9)
    y = np.repeat([1.0, 0.0], 800)
    margins = np.where(y == 1, 17.4, -17.4) + 6 * rng.normal(size=1600)
    margins[:8], margins[800:816] = -1, 2
    weights = np.zeros(1 << 20, np.float32)
    weights[:1600] = margins
    model = linear.calibrate(linear.Model(weights, 0.0), [np.array([i]) for i in range(1600)], y)
    p = np.array([model.probability(np.array([i])) for i in range(1600)])
    assert 0.05 < model.slope < 5 and -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 0.1


def test_long_training_texts_keep_all_their_features(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(60_000)]
    texts = ["a few words", "", " ".join(words[:10_000]), " ".join(words)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS toxic")
    rows = sampled(docs, labels, "toxic", toxicity.features, {1: 9}, {1: 9})[0]
    of = toxicity.features()
    want = sorted(np.sort(of(t)).tolist() for t in texts)
    assert sorted(x.tolist() for x in rows) == want and max(map(len, want)) > 400_000
    for n in (65_503, 65_504):
        x = np.random.default_rng(n).permutation(1 << 20)[:n].astype(np.int32)
        data = linear.packed(x)
        assert len(data) <= 1 << 17 and linear.Rows([data])[0].tolist() == np.sort(x).tolist()


def test_texts_of_one_id_whose_32_bit_hashes_clash(spark):
    """Documents that share an id, or have none, are told apart by 128 bits of their texts."""
    passage = [f"p{j}" for j in range(25)]
    many = spark.range(500_000).selectExpr("concat('a', id, ' b ', id * 7) AS t").selectExpr("t", "hash(concat(t, ' ', '" + " ".join(passage) + "')) AS h")
    clash = many.groupBy("h").agg(F.collect_list("t").alias("t")).filter("size(t) > 1").first().t[:2]
    for doc_id in (None, 5):
        rows = [(doc_id, f"{clash[0]} {' '.join(f'q{j}' for j in range(25))}"), (doc_id, f"{clash[0]} {' '.join(passage)}"), (doc_id, f"{clash[1]} {' '.join(passage)}")]
        rows += [(9, " ".join(passage)), (10, " ".join(f"q{j}" for j in range(25)))]
        got = substrings.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id in (9, 10)) == [(9, 25), (10, 25)]
        assert sum(r.n_removed for r in got if r.doc_id == doc_id) == 25


def test_open_windows_are_filled_from_the_emptiest():
    """At the end of a task most windows keep what the level rule put into them."""
    rng = random.Random(8)
    packer = packing.LevelPacker(2048)
    sizes = [min(2047, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(1250)]
    full = [w for i, n in enumerate(sizes) if (w := packer.place((i, 0, n, list(range(n)))))]
    before = {id(w): list(w) for ws in packer.windows.values() for w in ws}
    rest = list(packer.rest())
    lengths = [sum(len(p[3]) for p in w) for w in rest]
    assert all(n == 2048 for n in lengths if n & (n - 1)) and sum(lengths) + 2048 * len(full) == sum(sizes)
    kept = [w for w in rest if id(w) in before and w[: len(before[id(w)])] == before[id(w)]]
    assert len(rest) - len(kept) <= 12  # those of powers of two, and one
    ids = sorted((p[0], p[1] + k) for w in [*full, *rest] for p in w for k in range(len(p[3])))
    assert ids == [(i, k) for i, n in enumerate(sizes) for k in range(n)]
    own = sum(len(p[3]) for w in kept for p in before[id(w)])
    assert own > 0.6 * sum(lengths)


def test_mixing_with_more_rates_than_are_broadcast(spark, docs, repeated, monkeypatch):
    """The rows of a source are dealt to several tasks, and the copies are the same."""
    for rows in (docs, repeated, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        want = sorted(map(repr, mixing.mix(rows, mixing.size_tempered(rows)).collect()))
        monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 0)
        mixed = mixing.mix(rows, mixing.size_tempered(rows))
        assert sorted(map(repr, mixed.collect())) == want and mixed.columns == [*rows.columns, "copy", "shuffle_key"]
        assert "__own_salt" in mixed._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()
