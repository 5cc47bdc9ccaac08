"""Corpus operators against brute force on a small table with every awkward row."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from kvlog.llm import bpe, common, fingerprints, language, licences, nearest, packing, quality, seating, shards, similar, substrings, text, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0d]+")


def _texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdeéü", k=rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    base = [make(rng.randint(5, 60)) for _ in range(40)]
    near = [b.split() for b in base[:10]]
    for w in near:
        w[-1] = "changed"
    passage = make(30)
    out = [*base, *base[:3], *[" ".join(w) for w in near], make(20) + " " + passage, passage + " " + make(9), passage, make(12000)]
    out += [None, "", " \t\n ", "one", "one two three four", "ONE  Two\nthree four", "<|endoftext|> a <|startoftext|>b", "ΑΣ Σ İx ﬁ Å x\x1cy 漢字 é\xa0b", "a  b   c \n\n d\t e \n \n f", "it's we'll 12 ²½", "\n a", "a \n"]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(3 * i, t) for i, t in enumerate(_texts())]
    return [*out, out[5], (None, "no id at all but five words")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "x", 1, 2.0, "h") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, k string, n long, score double, h string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def _ordered(rows):
    return sorted(((common.NULL_KEY if i is None else i, t or "") for i, t in rows), key=lambda r: r[0])


def _split(t):
    return SPLIT.findall(t)


def test_words_and_grams():
    import pyarrow as pa

    texts = [t or "" for t in _texts()]
    w = text.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]])]
        assert got == _split(t)
        for x, h in zip(got, w.hash[w.at[i] : w.at[i + 1]].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_similar(docs, empty, rows):
    got = similar.similar_documents(docs, block=200).collect()
    sets = []
    for i, t in _ordered(rows):
        w = _split(t)
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    ids = [i for i, _ in sets]
    near = lambda a, b: a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)
    label = {i: i for i in ids}
    links = collections.Counter()
    for x in range(len(sets)):
        for y in range(len(sets)):
            if x != y and near(sets[x][1], sets[y][1]):
                links[ids[x]] += 1
                lo, hi = sorted((label[ids[x]], label[ids[y]]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    links[15] //= 2  # the row that is there twice
    back = lambda v: common.NULL_KEY if v is None else v
    assert {back(r.doc_id): back(r.class_id) for r in got} == label
    assert len(got) == len(rows) and {back(r.doc_id): r.n_links for r in got} == {i: links[i] for i in ids}
    assert similar.similar_documents(empty).count() == 0
    few, one = similar.bands_for(0.05, 0.9999)
    assert 1 - (1 - 0.05**one) ** few >= 0.9999
    bands, per = similar.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**per) ** bands >= 0.9999 and bands * per <= 128


def _remove(rows):
    first, out = {}, []
    for i, t in _ordered(rows):
        w = _split(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in _ordered(rows):
        w = _split(t)
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(docs, empty, rows):
    got = substrings.remove_repeats(docs).collect()
    assert sorted((common.NULL_KEY if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == _remove(rows)
    wide = substrings.remove_repeats(docs, with_text=True)
    assert wide.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256", "kept"] and wide.count() == len(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    assert sorted(map(tuple, wide.select("doc_id", "text").collect()), key=key) == sorted(map(tuple, docs.select("doc_id", "text").collect()), key=key)
    assert substrings.remove_repeats(empty).count() == 0
    lengths = {r.doc_id: r.longest for r in substrings.repeats(docs).collect()}
    assert lengths[159] == 26 and substrings.repeats(empty).count() == 0


def test_cut_returns_texts_of_several_slices():
    """Nulls between texts of more than one slice stay where they are."""
    n = 800
    texts = [None if i % 7 == 0 else f"w{i} " * (i % 900) for i in range(n)]
    none = pa.array([t is None for t in texts])
    cols = [pa.array(range(n)), pa.array([t or "" for t in texts]), pa.array([None] * n, pa.list_(pa.int64())), none]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array(range(n))], ["k", "text", "hs", "none", "_0"])
    parts = list(substrings._cut(13, True, ["_1"])([batch]))
    got = pa.Table.from_batches(parts)
    assert len(parts) > 1 and got.column("_1").to_pylist() == texts and got.column("_0").to_pylist() == list(range(n))


def test_fingerprints(docs, empty, rows):
    got = fingerprints.edited_fingerprints(docs).collect()
    order = _ordered({i: t for i, t in rows}.items())
    after = {i: order[(j + 1) % len(order)][1] for j, (i, _) in enumerate(order)}
    form = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    by = {}
    assert len(got) == len(rows)
    for r in got:
        i = common.NULL_KEY if r.doc_id is None else r.doc_id
        t = dict(order)[i]
        n = len(t)
        edited = t[: n - n // 2] + after[i][: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(form(t) == form(edited)) and r.near_next == float(form(t) == form(after[i]))
        by.setdefault(form(t).replace("\x1c", " "), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    g = {(r.doc_id, r.group_id, r.n_copies) for r in fingerprints.groups(docs).collect()}
    assert {x for x in g if x[0] in (0, 120)} == {(0, 0, 2), (120, 0, 2)}
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.groups(empty).count() == 0
    assert "Python" not in fingerprints.edited_fingerprints(docs)._jdf.queryExecution().toString()


def test_fingerprint_collisions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: (F.char_length(canon).cast("long"), F.lit(1).cast("long")))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA "), (4, "abc"), (5, "bb"), (6, "bb")], "doc_id long, text string")
    assert {r.doc_id: (r.group_id, r.n_copies) for r in fingerprints.groups(df).collect()} == {1: (1, 2), 3: (1, 2), 2: (2, 3), 5: (2, 3), 6: (2, 3), 4: (4, 1)}


def test_quality(spark, empty):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 90))) + "."
    bad = lambda: " ".join("".join(rng.choices("ABC$#!", k=rng.randint(2, 8))) + "!!" for _ in range(rng.randint(20, 90)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)] + [(400, None, 1), (401, "", 1), (None, good(), 1)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:400]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(d, y, F.col("doc_id") % 5 != 0).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 400]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)
    assert {r.score for r in quality.score_documents(d, y.where("false")).collect()} == {0.5}
    assert quality.score_documents(empty, y).count() == 0
    both = quality.score_documents(d, y)
    assert both.columns == ["doc_id", "text", "score", "predicted"] and {(r.doc_id, r.text) for r in both.collect()} == {(i, t) for i, t, _ in rows}
    assert quality.score_documents(d, y, columns=["doc_id"]).columns == ["doc_id", "score", "predicted"]
    twice = quality.score_documents(d.unionByName(d.limit(3)), y, F.col("doc_id") % 5 != 0).collect()
    assert len(twice) == len(rows) + 3
    for few in (1, 2, 3, 7, 9):  # the same path at any number of labels
        some = quality.score_documents(d, y.where(F.col("doc_id") < few)).collect()
        assert len(some) == len(rows) and all(0 <= r.score <= 1 for r in some)
    assert quality.isotonic(np.array([1, 2, 3.0]), np.array([1, 0, 2.0]), np.ones(3)).tolist() == [0.5, 0.5, 2.0]


def test_language(docs, empty, rows):
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 2 == 0
    got = language.language_scores(docs, train).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, [*_split(t.translate(low)), None]) for i, t in _ordered(rows)]
    c = collections.Counter()
    for i, w in toks:
        if i % 2 == 0 and i != common.NULL_KEY:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in toks)
    assert sorted((common.NULL_KEY if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert language.language_scores(empty, train).count() == 0
    assert {r.score for r in language.language_scores(docs.where("doc_id is null"), F.lit(False)).collect()} == {0.0}


def test_every_context_has_its_restaurant(spark):
    # 300 words that are equally frequent, each always followed by a word of its own.
    rng = random.Random(4)
    texts = []
    for _ in range(600):
        texts.append(" ".join(f"a{i} b{i}" for i in rng.sample(range(300), 20)))
    right, wrong, new = "a7 b7 a8 b8", "a7 b8 a8 b7", "zzz b7"
    rows = [(i, t) for i, t in enumerate([right, wrong, new, *texts])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in language.language_scores(df, F.col("doc_id") >= 3).collect() if r.doc_id < 3}
    assert got[0] - got[1] > 4 and -20 < got[2] < 0
    many = {r.doc_id: r.score for r in language.language_scores(df.where("doc_id in (0, 1)"), F.lit(False)).collect()}
    assert many == {0: 0.0, 1: 0.0}


def test_predictive_sums_to_one():
    # Words 0 and 1 follow context 1, word 2 follows context 2.
    t = language.Totals(3, 9, 1, 1, 5, 3)
    count, own = np.array([4, 3, 2]), np.array([1, 1, 2])
    tables, sizes = seating.start(count, np.array([0.3, 0.2, 0.4]), t.d, np.random.default_rng(0))
    t.customers = int(tables.sum())
    base = np.append(t.parent(tables, np.ones(3)), t.parent(np.zeros(1), np.zeros(1)))
    p = t.rest(np.array([7]), np.array([tables[:2].sum()])) * base + np.append(np.where(own == 1, (count - t.d * tables) / (language.THETA + 7), 0), 0)
    assert abs(base.sum() - 1) < 1e-9 and abs(p.sum() - 1) < 1e-9
    assert (1 <= tables).all() and (tables <= count).all() and sizes.sum() == count.sum()


@pytest.mark.parametrize("n, weight, d", [(3, 2.0, 0.3), (5, 0.7, 0.6), (8, 1.5, 0.8), (40, 3.0, 0.5)])
def test_seating_follows_its_law(n, weight, d):
    """The law of the number of tables, by recursion over customers."""
    law = np.array([0.0, 1.0] + [0.0] * n)
    for j in range(1, n):
        law[1:] = law[1:] * (j - d * np.arange(1, n + 2)) + law[:-1]
    law = law[1 : n + 1] * weight ** np.arange(1, n + 1)
    law /= law.sum()
    rng, rows = np.random.default_rng(1), 6000
    w = np.full(rows, weight)
    t, sizes = seating.start(np.full(rows, n), w, d, rng)
    for _ in range(20):
        t, sizes = seating.sweep(t, sizes, w, d, rng)
    assert abs(np.bincount(t, minlength=n + 1)[1:] / rows - law).max() < 0.025
    # Customers that come and go leave the law of those that are there.
    t, sizes = seating.sweep(t, sizes, w, d, rng, np.full(rows, 2))
    t, sizes = seating.sweep(t, sizes, w, d, rng, np.full(rows, -2))
    for _ in range(10):
        t, sizes = seating.sweep(t, sizes, w, d, rng)
    assert sizes.sum() == n * rows and abs(np.bincount(t, minlength=n + 1)[1:] / rows - law).max() < 0.025


def test_seating_of_many_customers():
    rng = np.random.default_rng(2)
    n, w = np.array([0, 1, 100_000, 50]), np.array([0.5, 0.5, 20.0, 1.0])
    t, sizes = seating.start(n, w, 0.6, rng)
    assert t[:2].tolist() == [0, 1] and 60 < t[2] < 400 and sizes.sum() == n.sum()
    t, sizes = seating.sweep(t, sizes, w, 0.6, rng, np.array([2, -1, 500, 0]))
    assert t[0] >= 1 and t[1] == 0 and np.bincount(np.repeat(np.arange(4), t), sizes).tolist() == [2, 0, 100_500, 50]


def _pitman_yor(train, ask, types, d, root_d, sweeps, burn):
    """One customer at a time, tables as lists, nothing in parallel. Mean probabilities of
    the pairs asked for."""
    rng = random.Random(5)
    rest: dict = collections.defaultdict(lambda: collections.defaultdict(list))
    root: dict = collections.defaultdict(list)

    def base(w):
        m, r, total, tables = sum(root[w]), len(root[w]), sum(map(sum, root.values())), sum(map(len, root.values()))
        return (m - root_d * r + (language.ROOT_THETA + root_d * tables) / (types + 1)) / (language.ROOT_THETA + total)

    def sit(tables, new, discount):
        weights = [s - discount for s in tables] + [new]
        at = rng.choices(range(len(weights)), weights)[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return at == len(tables) - 1 and tables[at] == 1

    def stand(tables):
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def seat(u, w):
        if sit(rest[u][w], (language.THETA + d * sum(map(len, rest[u].values()))) * base(w), d):
            sit(root[w], (language.ROOT_THETA + root_d * sum(map(len, root.values()))) / (types + 1), root_d)

    for u, w in train:
        seat(u, w)
    out = np.zeros(len(ask))
    for i in range(sweeps):
        for u, w in train:
            if stand(rest[u][w]):
                stand(root[w])
            seat(u, w)
        if i >= burn:
            for j, (u, w) in enumerate(ask):
                c, t = sum(map(sum, rest[u].values())), sum(map(len, rest[u].values()))
                out[j] += (sum(rest[u][w]) - d * len(rest[u][w]) + (language.THETA + d * t) * base(w)) / (language.THETA + c) / (sweeps - burn)
    return out


def test_language_against_one_customer_at_a_time(spark):
    rng = random.Random(8)
    vocab = "ab bc cd de ef fg gh hi ij jk".split()
    texts = [" ".join(rng.choices(vocab[:6], weights=(9, 5, 3, 2, 1, 1), k=rng.randint(3, 12))) for _ in range(30)]
    texts += [" ".join(rng.choices(vocab, k=6)) for _ in range(6)] + ["", "ab zz ab"]
    rows = list(enumerate(texts))
    held = {i for i, _ in rows if i >= 30}
    got = {r.doc_id: r.score for r in language.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") < 30, burn_in=5, samples=15, shards=3).collect()}
    pairs = lambda t: list(zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    train = [p for i, t in rows if i not in held for p in pairs(t)]
    n = collections.Counter(collections.Counter(train).values())
    d = min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.05), 0.95)
    ask = [(i, p) for i, t in rows for p in pairs(t)]
    p = _pitman_yor(train, [p for _, p in ask], len({w for _, w in train}), d, 0.5, 700, 100)
    want = collections.Counter()
    for (i, _), x in zip(ask, p):
        want[i] += math.log10(x)
    far = {i: (got[i], want[i]) for i in want if abs(got[i] - want[i]) >= 0.03 * abs(want[i]) + 0.05}
    assert not far, far


def test_bpe(docs, empty, rows):
    tok = Tokenizer.from_file(WORD)
    got = tokens.encode_documents(docs, WORD, with_values=True).collect()
    texts = dict(_ordered(rows))
    assert len(got) == len(rows)
    for r in got:
        ids = tok.encode(texts[common.NULL_KEY if r.doc_id is None else r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    e = bpe.Encoder(WORD)
    assert e.decode(e.ids("Hello there")) == tok.decode(e.ids("Hello there"), skip_special_tokens=False)
    assert tokens.encode_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library(path):
    import pyarrow as pa

    texts = [t or "" for t in _texts()] + [" a\n\nb c\n d", "x \xa0 y", "word\n\nTwo words\nthree", "  lead", "trail  "]
    tok, lib = Tokenizer.from_file(path), bpe.Library(path)
    for _ in range(2):
        ids, at = lib.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, empty, rows):
    tok = Tokenizer.from_file(WORD)
    ids = [(i, [*tok.encode(t, add_special_tokens=False).ids, 1]) for i, t in _ordered(rows)]
    for capacity, group in ((4096, 8192), (64, 8)):
        got = packing.pack(common.save(packing.pieces(docs, WORD, capacity=capacity), "p"), capacity, group).collect()
        want = sorted((i, p, at, len(x[at : at + capacity]), zlib.crc32(np.array(x[at : at + capacity], "<u4").tobytes())) for i, x in ids for p, at in enumerate(range(0, len(x), capacity)))
        assert sorted((r.k, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= capacity
        least = -(-sum(len(x) for _, x in ids) // capacity)
        assert len(bins) <= least * 1.15 + 1
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_deals_repeated_rows(spark, monkeypatch):
    most = []

    def save(df, name):
        out = common.save(df, name)
        if name == "groups":
            most.append(out.agg(F.max(F.size("items"))).first()[0])
        return out

    monkeypatch.setattr(packing, "save", save)
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    cut = common.save(packing.pieces(rows, WORD, capacity=64), "p")
    got = packing.pack(cut, 64, 100)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("o"), F.count("*").alias("c")).collect()
    assert most and max(most) < 200 and sum(b.c for b in bins) == 2000
    assert all(b.n <= 64 and b.o == b.c for b in bins)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[5:9] = x[4]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, 2.0]), (None, [0.0] * 8), (4, [float(v) for v in x[4]])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = nearest.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard=64).collect()
    q = np.floor(64 * x.astype(float))
    for me in range(0, 300, 20):
        s = q @ q[me]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != me][:7]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == me] == [(j, int(s[j])) for j in order]
    assert nearest.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    every = nearest.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard=64, boxes=0).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, got))


def test_top_k_of_great_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=4) * 10.0 ** rng.choice([0, 4, 9, 18, 30])]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: [math.floor(64 * v) for v in x] for i, x in rows}
    got = nearest.top_k(df, F.col("vec_id") % 20 == 0, k=9, shard=32).collect()
    for me in range(0, 120, 20):
        order = sorted((-sum(a * b for a, b in zip(whole[me], x)), i) for i, x in whole.items() if i != me)[:9]
        want = [(i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in order]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == me] == want


def test_far_boxes_are_not_searched():
    x = np.arange(20.0).reshape(10, 2)
    box = lambda shard, x: type("Box", (), {"dim": 2, "shard": shard, "box_low": x.min(0).tolist(), "box_high": x.max(0).tolist()})()
    import pyarrow as pa

    batch = pa.record_batch([pa.array([2], pa.int32()), pa.array([0]), pa.array([5]), pa.array([[1.0, 1.0]]), pa.array([30])], ["dim", "own", "vec_id", "v", "kth"])
    out = list(nearest._send([box(0, x), box(1, x), box(2, -x), box(-1, -x)])([batch]))
    assert out[0].column("shard").to_pylist() == [1, -1]


def test_shards(docs, empty, rows):
    tok = Tokenizer.from_file(BYTE)
    files = shards.write_shards(docs, BYTE, tokens=500)
    got = sorted(shards.read_shards(files, with_ids=True).collect(), key=lambda r: (r.start, r.n_tokens))
    at = 0
    texts = dict(_ordered(rows))
    assert [common.NULL_KEY if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in _ordered(rows)]
    for r in got:
        ids = [*tok.encode(texts[common.NULL_KEY if r.doc_id is None else r.doc_id], add_special_tokens=False).ids, 0]
        assert r.start == at and r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
        assert (r.first_id, r.n_ends, r.last_end) == (ids[0], ids.count(0), at - 1)
    assert shards.read_shards(shards.write_shards(empty, BYTE)).count() == 0


@pytest.mark.parametrize("block, n", [(64, 3000), (1 << 18, 3000), (64, 64), (64, 1), (64, 0)])
def test_wavelets(monkeypatch, block, n):
    monkeypatch.setattr(shards, "_BLOCK", block)
    ids = np.random.default_rng(0).integers(0, 300, n)
    keys, starts, w = shards.unpack(shards.pack(np.array([1, 2]), np.array([0, 1, n]), ids, 9))
    assert keys.tolist() == [1, 2] and starts.tolist() == [0, 1, n] and not any(p.open for p in w.planes)
    every = np.arange(n)
    assert (w.decode() == ids).all() and (not n or (w.access(every) == ids).all())
    for v in (0, 7, 299, 511, 5000):
        at = np.flatnonzero(ids == v)
        if len(at):
            assert (w.locate(v, np.arange(len(at))) == at).all()
        lo, hi = np.array([0, n // 3, n]), np.array([n, n // 2, n])
        assert w.count(v, lo, hi).tolist() == [int((ids[a:b] == v).sum()) for a, b in zip(lo, hi)]
    with pytest.raises(ValueError):
        shards.pack(np.array([1]), np.array([0, 1]), np.array([512]), 9)


def test_bits_follow_the_vocabulary(spark, tmp_path):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 70_000, "content": "<|far|>"})
    (tmp_path / "far.json").write_text(json.dumps(spec))
    assert shards.id_bits(BYTE) == 16 and shards.id_bits(str(tmp_path / "far.json")) == 17
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.ids[-1] for r in shards.read_shards(shards.write_shards(df, BYTE, end=70_000), True, 70_000).collect()] == [70_000] * 2
    with pytest.raises(Exception, match="does not fit"):
        shards.write_shards(df, BYTE, end=70_000, bits=16)


def test_long_words():
    import time

    tok, e = Tokenizer.from_file(WORD), bpe.Encoder(WORD)
    rng = random.Random(4)
    for n in (255, 256, 257, 400, 3000):
        t = "".join(rng.choices("abcdefghij", k=n)) + " " + "a" * n
        assert e.ids(t) == tok.encode(t, add_special_tokens=False).ids
    begin = time.time()
    t = "".join(rng.choices("etaoin", k=200_000))
    assert e.ids(t) == tok.encode(t, add_special_tokens=False).ids and time.time() - begin < 30


def test_crossover_beats_best_fit():
    """Triples that fill bins wholly, which best fit in falling order misses."""
    rng = np.random.default_rng(3)
    a = rng.integers(24, 37, 40)
    b = np.array([rng.integers(26, 100 - x - 25) for x in a])
    sizes = np.concatenate([a, b, 100 - a - b])
    first = packing.Island(sizes, 100, 0)
    alone = first.loads(first.seed(0.0))
    assert first.least == 40 and len(alone) > 41
    seeds = [first.seed(0.05 * i) for i in range(6)]
    best_seed = min(len(first.loads(x)) for x in seeds)
    best = packing.Island(sizes, 100, 1).evolve(seeds, 6, 3000)
    loads = first.loads(best)
    assert len(loads) < min(best_seed, len(alone)) and loads.max() <= 100 and loads.sum() == sizes.sum()
    # An elite that another island sends takes part, and is not lost.
    assert len(first.loads(packing.Island(sizes, 100, 2).evolve([seeds[0], best], 2, 5))) <= len(loads)


def test_elites_arrive(spark, monkeypatch):
    """After an epoch each island works on its own solution and its neighbour's elite."""
    seen = []

    def save(df, name):
        out = common.save(df, name)
        if name == "islands":
            seen.append({(r.grp, r.island): (r.used, r.squares) for r in out.collect()})
        return out

    monkeypatch.setattr(packing, "save", save)
    rng = random.Random(3)
    two = [(a, rng.randint(26, 74 - a)) for a in (rng.randint(24, 36) for _ in range(30))]
    rows = [(i, j, 0, x, 0) for i, (a, b) in enumerate(two) for j, x in enumerate((a, b, 100 - a - b))]
    cut = common.save(spark.createDataFrame(rows, "k long, piece int, start long, length long, ids_crc32 long"), "p")
    packing.pack(cut, 100, 1000).count()
    rank = lambda x: (-x[0], x[1])
    assert len(seen) == packing.EPOCHS and len(seen[0]) == packing.ISLANDS
    for (grp, island), x in seen[1].items():
        assert rank(x) >= max(rank(seen[0][grp, island]), rank(seen[0][grp, (island - 1) % packing.ISLANDS]))


def test_licences(spark):
    known = {"plain": "Permission is hereby granted, free of charge, to any person.", "other": "Redistribution and use are permitted"}
    texts = [(1, 'Copyright (c) 2020 Someone\n\nPERMISSION is hereby granted;  free of charge -- to any person'), (2, "something else"), (3, None), (4, "Redistribution and use are permitted provided"), (5, "© 1999 X\nRedistribution and use are permitted")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, licence string")
    assert {r.doc_id: r.licence for r in licences.find(df, known).collect()} == {1: "plain", 2: None, 3: None, 4: None, 5: "other"}
    assert licences.find(df.where("false"), known).count() == 0
    mit, zlib_ = licences.KNOWN["MIT"], licences.KNOWN["Zlib"]
    whole = [(1, f"The MIT License (MIT)\n\nCopyright (c) 2019 A B\n\n{mit}"), (2, f"Copyright <YEAR> <HOLDER>\n{mit.upper()}"), (3, f"zlib License\n\n(C) 1995-2013 X and Y\n\n  {zlib_}\n"), (4, mit + " More.")]
    got = licences.find(spark.createDataFrame(whole, "doc_id long, text string"), licences.TEXTS).collect()
    assert {r.doc_id: r.licence for r in got} == {1: "MIT", 2: "MIT", 3: "Zlib", 4: None}


def test_common_licences_are_known(spark):
    want = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
    texts = [(i, licences.KNOWN[name]) for i, name in enumerate(want)]
    texts += [(20, "BSD 3-Clause License\n\nCopyright (c) 2020, A B\nAll rights reserved.\n\n" + licences.KNOWN["BSD-3-Clause"]), (21, licences.KNOWN["Apache-2.0"].split("APPENDIX")[0]), (22, "Licensed under the Apache License, Version 2.0")]
    got = licences.find(spark.createDataFrame(texts, "doc_id long, text string"), licences.TEXTS).collect()
    assert {r.doc_id: r.licence for r in got} == {**dict(enumerate(want)), 20: "BSD-3-Clause", 21: "Apache-2.0", 22: None}
    assert len(want) < len(licences.KNOWN) and all(len(t) > 300 for t in licences.KNOWN.values())


def test_licence_notices(spark):
    mit, isc, gpl, bsd = (licences.KNOWN[x] for x in ("MIT", "ISC", "GPL-3.0", "BSD-3-Clause"))
    texts = [
        ("MIT License Copyright (c) 2019 A B " + mit, "MIT"),
        ("Copyright © 2019-2021 A B, Inc. All rights reserved. " + bsd.replace("\n", " "), "BSD-3-Clause"),
        ("Copyright 2012 A B Copyright (c) 2019 C D <c@d.org> " + mit, "MIT"),
        (" * Copyright (c) 2019, 2020 A. B. Corp. <a@b.org>, C D. All rights reserved.\r\n" + mit, "MIT"),
        (" ".join(gpl.split()), "GPL-3.0"),
        ("The story of our shop, all rights reserved by no one, goes on here.\n" + mit, None),
        ("Copyright (c) 2019 A B. This text is ours. Call us for a licence.\n" + mit, None),
        ("Some prose before it. Copyright (c) 2019 A B " + mit, None),
        ("MIT License Copyright (c) 2019 A B " + isc, None),
        ("MIT License Copyright (c) 2019 A B " + mit + " And more.", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.find(df, licences.TEXTS).collect()} == {i: x for i, (_, x) in enumerate(texts)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((label[a], label[b]))
        label = {k: lo if v == hi else v for k, v in label.items()}
    got = {r.u: r.v for r in similar.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and all((i in ids) == bool(q) for i, q in labels.items())
    one = P.near_duplicates(spark, kept, sf)
    classes = {r.class_id for r in similar.similar_documents(kept).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(classes)
    cut = P.repeated_passages(spark, one, sf)
    want = {i: (n, d) for i, _, n, d in _remove([(r.doc_id, r.text) for r in one.collect()])}
    for r in cut.collect():
        assert hashlib.sha256(" ".join(_split(r.text)).encode()).hexdigest() == want[r.doc_id][1] and r.n_chars == len(r.text)
    assert {r.doc_id for r in P.run(spark, sf).collect()} == classes
    assert P.run(spark, sf).columns == P.packing(spark, cut, sf).columns


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as P

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(None, a), (None, b), (5, a + " more"), (9, b + " more"), (7, "one text of this id"), (7, "and quite another text"), (7, "one text of this id"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect())
    assert got == collections.Counter([(None, a), (None, b), (7, "one text of this id"), (7, "and quite another text"), (None, None)])


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Every name that an operator uses, nulls, empty texts and repeated rows."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    names = "score predicted kept n_words n_removed kept_sha256 _row _own_1 k x y hs h g class_id set_id n_links length piece start sequence_id offset grp".split()
    odd = spark.createDataFrame([(None, None, None), (900_001, "", 0), (900_001, "", 0), (900_002, None, 0)], "doc_id long, text string, n_chars long")
    wide = docs.unionByName(odd, allowMissingColumns=True).select("*", *[F.lit(9).alias(n) for n in names])
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, sf)
        got = out.collect()
        assert out.columns == wide.columns and all(r[n] == 9 for r in got for n in names)
        if name == "repeated_passages":
            want = collections.Counter((i, d) for i, _, _, d in _remove(rows))
            back = lambda v: common.NULL_KEY if v is None else v
            assert collections.Counter((back(r.doc_id), hashlib.sha256(" ".join(_split(r.text or "")).encode()).hexdigest()) for r in got) == want
        else:
            assert {(r.doc_id, r.text) for r in got} <= set(rows)
        if name == "near_duplicates":
            assert sum(not _split(r.text or "") for r in got) == 1
    assert P.packing(spark, wide, sf).where("piece = 0").count() == len(rows)  # long texts have more pieces
    none = wide.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_texts_longer_than_a_slice(spark):
    """Each operator on a text of more than two slices of bytes, beside short ones."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(3000)]
    long = " ".join(rng.choices(vocab, k=2 * text.SLICE // 5 + 1000))
    assert len(long) > 2 * text.SLICE - 300_000
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = len(long.split())
    near = {r.doc_id: (r.class_id, r.n_links) for r in similar.similar_documents(df).collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert cut == {1: (words, 0), 2: (words + 1, words), 3: (2, 0), 4: (0, 0)}
    prints = {r.doc_id: (r.n_chars, r.near_next) for r in fingerprints.edited_fingerprints(df).collect()}
    assert prints == {1: (len(long), 0.0), 2: (len(long) + 4, 0.0), 3: (9, 0.0), 4: (0, 0.0)}
    y = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score_documents(df, y).count() == 4
    assert {r.doc_id: r.licence for r in licences.find(df, licences.TEXTS).collect()} == dict.fromkeys((1, 2, 3, 4))
    tok = Tokenizer.from_file(WORD)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.encode_documents(df, WORD).collect()} == {i: len(x) for i, x in ids.items()}
    packed = packing.pack_documents(df, WORD).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(x) + 1 for i, x in ids.items()}
    byte = Tokenizer.from_file(BYTE)
    read = {r.doc_id: r.n_tokens for r in shards.read_shards(shards.write_shards(df, BYTE)).collect()}
    assert read == {i: len(byte.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    scored = {r.doc_id: (r.n_tokens, r.n_known) for r in language.language_scores(df, F.col("doc_id") < 2, 1, 1).collect()}
    assert scored[1] == (words + 1, words + 1) and scored[2][0] == words + 2 and scored[4] == (1, 1)
