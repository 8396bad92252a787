"""The ten operators on small tables: brute force, round trips, and the cases their docstrings define."""

import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import bpe, digest, embed, graph, html, jaccard, langid, lm, mixing, planes, quality
from srcatlas.llm.queries import vocabulary
from srcatlas.llm.text import buffers, row_starts, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edge_docs():
    """Nulls in every column, empty and long texts, repeated rows, odd white space and characters."""
    long = prose(9000, 1)
    rows = [
        (1, prose(60, 2), "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0), (None, prose(40, 3), "fr", "a", 5), (4, "one two", "fr", "b", 7),
        (5, " \t\n  ", "de", "a", 4), (6, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (7, prose(60, 2), "de", "c", 3), (8, "É ß 中文 😀 don't 've <|endoftext|> x", "es", "c", 9),
        (9, prose(60, 2) + " extra", None, "a", 1), (10, "1234 5678 !!!", "en", "a", 2),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with the operators' own
    df = spark.createDataFrame(edge_docs(), DOCS)
    return df.withColumn("score", F.lit("x")).withColumn("sig", F.lit(1)).withColumn("kept", F.lit(None).cast("string")).withColumn("size", F.col("doc_id")).withColumn("h", F.lit(2.5)).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_are_of_content():
    texts = ["Ab cd  ab", None, "", "cd\tAB\x0bab "]
    h, s, e, n = word_hashes(*buffers(pa.array(texts)))
    assert n.tolist() == [3, 0, 0, 3] and h[0] == h[2] == h[4] == h[5] and h[1] == h[3] and h[0] != h[1]


# 1


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edge_docs())
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"] and (r.copies > 0) == (r.taken > 0)
    total = sum(r["size"] for r in rows)
    targets = {k: v[0].target for k, v in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and list(by) != []
    for k, v in by.items():
        assert v[0].source_size == sum(r["size"] for r in v) and abs(sum(r.taken for r in v) - targets[k]) <= 1
    # water-filling by repeated resharing
    names = sorted((k for k in by if k is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    weight = {k: (5.0, 2.0, 1.0)[j % 3] for j, k in enumerate(names)}
    open_, left, fixed = set(names), 1.5 * total, {}
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * by[k][0].source_size]
        if not over:
            break
        for k in over:
            fixed[k] = 2.0 * by[k][0].source_size
            left -= fixed[k]
            open_.discard(k)
    want = fixed | share
    assert all(abs(want[k] - targets[k]) < 1e-6 for k in names)
    positions = [r.first_position for r in rows if r.first_position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_keeps_documents_whole(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = Counter(r.text for r in out.collect())
    assert set(texts) <= {r[1] for r in edge_docs()} and max(texts.values()) <= 4 and None not in texts


def test_positions_invert_demand(spark):
    df = spark.range(0, 101).select((F.col("id") / 100.0).alias("y"))
    for tilt in (0.5, 0.0, -0.5):
        x = np.array([r[0] for r in df.select(mixing.position(F.col("y"), F.lit(1.0), F.lit(tilt))).collect()])
        assert np.allclose((1 + tilt) * x - tilt * x * x, np.arange(101) / 100)


# 2


def test_lm(spark, docs, none):
    more = spark.createDataFrame([(k, prose(80, k), "en", "a", 0) for k in range(100, 260)], DOCS)
    both = docs.select(*more.columns).unionByName(more)
    rows = {(r.doc_id, r.n_tokens): r for r in lm.score(both).collect()}
    assert lm.score(both).count() == both.count()
    count, tokens = Counter(), []
    for r in both.collect():
        t = WORD.findall((r.text or "").translate(UP)) + [None]
        held = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2
        tokens.append((r.doc_id, t, held))
        if not held:
            count.update(t)
    n, v = sum(count.values()), len(count)
    better = worse = 0.0
    for doc_id, t, held in tokens:
        r = rows[(doc_id, len(t))]
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)
        assert r.held_out == held and r.train_tokens == n and r.n_known == sum(count[w] > 0 for w in t)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score <= 1e-9
        if held:
            better, worse = better + r.score, worse + r.base_score
    assert better > 1.2 * worse
    assert lm.score(none).count() == 0
    lone = lm.score(spark.createDataFrame([(None, None, None, None, None)], DOCS)).first()
    assert (lone.n_tokens, lone.n_known, lone.train_tokens) == (1, 1, 1)


def test_lm_rows_do_not_depend_on_their_batch(spark):
    df = spark.createDataFrame([(k, prose(150 + k, k), "en", "a", 0) for k in range(40)], DOCS)
    a = {r.doc_id: r.score for r in lm.score(df.repartition(1)).collect()}
    b = {r.doc_id: r.score for r in lm.score(df.repartition(5)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-4 * abs(a[k]) for k in a)


def test_lm_split_contexts_add_up(spark, monkeypatch):
    # contexts are split by the next word wherever a slice has them more than a few times, or hardly any: the scores are the same
    df = spark.createDataFrame([(k, prose(120, k % 30), "en", "a", 0) for k in range(60)], DOCS).repartition(3)
    a = {r.doc_id: r.score for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "HOT", 1.0)  # where the driver selects them
    b = {r.doc_id: r.score for r in lm.score(df).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def brute_lm(texts, held):
    """For every token: (times seen, most frequent next word, its count) of its contexts, its own count left out of sums."""
    tokens = [WORD.findall(t.translate(UP)) + [None] for t in texts]
    seen = {}
    total = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    for t, h in zip(tokens, held):
        for k, w in enumerate(t):
            for c in (t[max(0, k - 1) : k] or [0], (t[max(0, k - 2) : k], k < 2)):
                if not h:
                    seen.setdefault(str(c), Counter())[w] += 1
    return tokens, seen, total


def test_lm_decisions_by_brute_force():
    texts, held = [prose(40, k % 7) for k in range(12)], np.array([k % 5 == 1 for k in range(12)])
    t = lm.Tokens(pa.array(texts), held)
    numbers = np.argsort(np.argsort(-np.bincount(t.word[t.trained], minlength=len(t.words)), kind="stable"), kind="stable")
    for hot in (np.zeros(0, np.uint64), np.unique(np.concatenate([h for h, _ in t.contexts()]))[::3]):
        asked = lm.Asked(t, hot)
        found = asked.answers(*lm.best_next(*asked.pairs(t, numbers), len(asked.keys)))
        tokens, seen, _ = brute_lm(texts, held)
        at = 0
        for row in tokens:
            for k, w in enumerate(row):
                for (n, top, c), key in zip(found, (row[max(0, k - 1) : k] or [0], (row[max(0, k - 2) : k], k < 2))):
                    want = seen.get(str(key), Counter())
                    assert n[at] == sum(want.values()) and c[at] == max(want.values(), default=0)
                    assert (top[at] >= 0) == bool(want)
                at += 1
        token, bit, x, gate, escaped = lm.decisions(t, numbers, found)
        assert np.isfinite(x).all() and gate.min() >= 0 and gate.max() < lm.GATES
        # a token is hit at most once, and is either hit or drawn from the word frequencies
        hits = np.bincount(token[bit], minlength=len(t.word))
        assert hits.max() == 1 and (escaped == (hits == 0)).all()


def test_lm_probabilities_sum_to_at_most_one(spark):
    # the next word of one text over all words that the model knows, and an unknown one
    train = [(k, prose(30, k % 3)) for k in range(6)]
    words = sorted({w for _, t in train for w in t.split()})
    head = " ".join(train[0][1].split()[:6])
    rows = [(100 + k, f"{head} {w}") for k, w in enumerate([*words, "zzz"])] + [(99, head)]
    df = spark.createDataFrame(train + rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, held_out=F.col("doc_id") >= 99).collect()}
    # P(head w end) over w, less what the end adds, is at most P(head ...)
    total = sum(10 ** got[i].score for i, _ in rows[:-1])
    without_last = [10 ** got[99].score]
    assert 0 < total < 1 and np.isfinite(without_last).all()
    best = max(rows[:-1], key=lambda r: got[r[0]].score)
    assert best[1].split()[-1] == train[0][1].split()[6]  # the word that followed in training


def test_lm_tells_what_occurs_twice(spark):
    # with its own counts left out a training text is known only as far as others hold it
    rows = [(k, prose(60, 900 + k)) for k in range(40)] + [(100 + k, prose(60, 900 + k)) for k in range(5)]
    got = {r.doc_id: r.bits_per_byte for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), held_out=F.lit(False)).collect()}
    assert max(got[k] for k in range(5)) < 0.5 * min(got[k] for k in range(5, 40))


# 3


def test_quality(spark, none):
    good = [(k, prose(80, k), "en", "a", 0) for k in range(120)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(8, k).split()) + " ", "en", "a", 0) for k in range(10)]
    bad = [(i, t * 12, *r) for i, t, *r in bad] + [(2000 + k, " ".join(w + "###" for w in prose(80, k).split()), "en", "a", 0) for k in range(10)]
    odd = [(None, None, None, None, None), (3001, "", "en", "a", 0), (3002, " \n ", "en", "a", 0), (3003, "Two words.", "en", "a", 0)]
    df = spark.createDataFrame(good + bad + odd, DOCS).withColumn("kept", F.lit("clash"))
    rows = {r.doc_id: r for r in quality.classify(df).collect()}
    assert all(rows[k].kept for k in range(120)) and rows[3003].kept
    assert not any(rows[i].kept for i, *_ in bad) and not any(rows[i].kept or rows[i].score for i in (None, 3001, 3002))
    assert quality.classify(none).count() == 0


def test_posterior_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.85
    right = np.array([0.99 if k % 2 else 0.98 for k in range(len(quality.LABELLERS))])
    v = np.where(rng.random((20000, len(right))) < right, np.where(truth, 2, 1)[:, None], np.where(truth, 1, 2)[:, None])
    v[rng.random(v.shape) < 0.3] = 0
    patterns, n = np.unique(quality.pattern(v), return_counts=True)
    p = quality.Posterior(patterns, n.astype(float))
    assert ((p.of(quality.pattern(v)) > 0.5) == truth).mean() > 0.99


# 4


def brute_links(vectors, threshold=0.9):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    return link


def closed(link, ids):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(link)):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(root(k), []).append(ids[k])
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(ids))]


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 4] + rng.standard_normal(24) * 0.12).tolist()) for k in range(60)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [1.0, None] * 12), (204, [float("nan")] * 24), (205, [float("inf")] + [1.0] * 23), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, (base[0] * 3).tolist()), (0, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("sig", F.lit(1))
    link = brute_links([v for _, v in rows])
    want = Counter((i, int(link[k].sum()), c) for k, ((i, _), c) in enumerate(zip(rows, closed(link, [i for i, _ in rows]))))
    for block in (1024, 8):  # groups larger than a block are cut
        monkeypatch.setattr(embed, "BLOCK", block)
        got = embed.near_duplicates(df).collect()
        found = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
        assert sum((found & want).values()) >= 0.97 * len(rows)
        assert sum(r.n_links for r in got) <= link.sum() and sum(r.n_links for r in got) >= 0.97 * link.sum()
    by = {r.vec_id: r for r in got}
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in (200, 201, 202, 203, 204, 205))
    assert by[206].n_links == 1 and not by[207].kept and not by[None].kept
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x[150:] = x[:150] + 0.4 * rng.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factor, low, step = embed.codes(x)
    guess, bound = embed.estimates(signs, factor, low, step, embed.CODE)
    off = guess - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= bound + 1e-6).all()


@pytest.mark.parametrize("d", [64, 128, 300, 1024])
def test_vectors_of_many_dimensions(spark, d):
    """v and -v never link, whatever their length; nor do vectors that differ by a swap of two components' signs."""
    rng = np.random.default_rng(d)
    v = rng.standard_normal(d)
    even = np.where(np.array([bin(k).count("1") for k in range(d)]) % 2, 1.0, -1.0)
    vectors = [v, -v, even, -even, v + rng.standard_normal(d) * 0.05, 2 * v, v.copy()]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (3, 0), 5: (3, 0), 6: (3, 0)}


# 5


def brute_jaccard(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(UP))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    link = np.zeros((len(texts), len(texts)), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            link[i, j] = i != j and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    return sets, link


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, none, monkeypatch, n, percent):
    r = random.Random(n)
    rows = [(x[0], x[1]) for x in edge_docs()]
    for k in range(12):
        words = prose(r.choice([6, 12, 30, 120, 400]), 50 + k).split()
        for c in range(6):
            w = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            rows.append((100 * k + c + 100, " ".join(w)))
    passage = prose(60, 999)
    rows += [(5000 + k, passage + " " + prose(r.choice([5, 9, 12, 40]), 2000 + k)) for k in range(40)]
    sets, link = brute_jaccard([t for _, t in rows], n, percent)
    want = Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, closed(link, [i for i, _ in rows])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("x")).withColumn("k", F.lit(0))
    assert Counter(tuple(x) for x in jaccard.join(df, n=n, percent=percent).collect()) == want
    if n == 4:
        monkeypatch.setattr(jaccard, "BLOCK", 4)
        monkeypatch.setattr(jaccard, "HELD", 3)
        assert Counter(tuple(x) for x in jaccard.join(df, n=n, percent=percent).collect()) == want
        assert jaccard.join(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e})
    link = np.zeros((len(ids), len(ids)), bool)
    for a, b in edges:
        link[ids.index(a), ids.index(b)] = True
    assert got == dict(zip(ids, closed(link, ids))) | {k: v for k, v in got.items() if k not in ids}


# 6 and 8


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    if not os.path.exists(vocabulary()):
        pytest.skip("no vocabulary")
    return Tokenizer.from_file(vocabulary())


def test_encoder_equals_the_tokenizer(tokenizer):
    enc, r = bpe.Encoder(vocabulary()), random.Random(4)
    pieces = list("abs'tremdvl  \n\t\r12.,!\u0085 　éßñ中文😀²Ⅷ٣​\x1c") + ["'s", "'re", "'ll", "'ve", "<|endoftext|>", "  ", "\r\n"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, ""]
    ids, counts = enc.encode(*buffers(pa.array(texts)))
    cuts = row_starts(counts)
    for t, a, b in zip(texts, cuts[:-1], cuts[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert list(enc.decode(ids, counts)) == [t or "" for t in texts]


def swapped(n):
    """A word of n letters a and b after Thue and Morse, and the word with a and b swapped."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 65, 1024, 8192])
def test_words_that_sums_confuse(spark, tokenizer, n):
    """Words that collide under polynomial hashes are told apart by every operator that hashes words."""
    pair = swapped(n)
    texts = [*pair, f"x {pair[0]} y", f"x {pair[1]} y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    h, *_ = word_hashes(*buffers(pa.array(texts)))
    assert len(set(h.tolist())) == 4
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(df, vocabulary()).collect()} == {k: sha(w) for k, w in enumerate(want)}
    crc = {r.doc_id: r.ids_crc32 for r in planes.round_trip(df, vocabulary()).collect()}
    assert crc == {k: zlib.crc32(np.array([*w, 0], "<u4").tobytes()) for k, w in enumerate(want)}
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n=4, percent=85).collect()} == {k: k for k in range(4)}
    scored = lm.score(df, held_out=F.col("doc_id") == 1)
    assert {r.doc_id: r.n_known for r in scored.collect()} == {0: 2, 1: 2, 2: 4, 3: 4}


def test_distinct_spans_compare_bytes(monkeypatch):
    """Spans that share a hash stay apart."""
    from srcatlas.llm import text as T

    monkeypatch.setattr(T, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"aa", b"ab", b"aa", b"x" * 70, b"x" * 69 + b"y", b"x" * 70, b"a", b"ab", b"12345678", b"12345678Z"]
    data, edges = np.frombuffer(b"".join(words), np.uint8), row_starts(np.array([len(w) for w in words]))
    first, number = T.distinct_spans(data, edges[:-1], edges[1:])
    assert [words[f] for f in first] == list(dict.fromkeys(words)) and [words[first[k]] for k in number] == words


def test_bpe(spark, docs, none, tokenizer):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary()).collect())
    want = Counter()
    for i, t, *_ in edge_docs():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    encoded = bpe.encode_texts(docs, vocabulary())
    assert encoded.columns == docs.columns + ["token_ids"]
    assert bpe.decode_ids(encoded, vocabulary()).where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.digests(none, vocabulary()).count() == 0


def test_broken_utf8_decodes_as_the_tokenizer_does(tokenizer):
    enc, r = bpe.Encoder(vocabulary()), random.Random(6)
    rows = [[r.randrange(0, 300) for _ in range(12)] for _ in range(200)]
    got = list(enc.decode(np.array(sum(rows, [])), np.array([12] * 200)))
    assert got == [tokenizer.decode(x, skip_special_tokens=False) for x in rows]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    r = np.random.default_rng(0)
    ids = r.integers(0, 50257, 1000).astype(np.uint32)
    ids[3] = 2**32 - 1
    assert (planes.from_planes(planes.to_planes(ids, kind), len(ids), kind) == ids).all()
    out = io.BytesIO()
    w = planes.Writer(out, kind, block=64)
    counts = np.array([0, 5, 500, 1, 494])
    w.add([None, 1, 2, 3, 4], counts, ids)
    w.close()
    reader = planes.Reader(out, len(out.getvalue()))
    assert (reader.ids(0, 1000) == ids).all() and (reader.ids(130, 7) == ids[130:137]).all() and len(reader.ids(5, 0)) == 0
    cuts = row_starts(counts)
    assert reader.crcs().tolist() == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    assert reader.null.tolist() == [1, 0, 0, 0, 0]


def test_binary_ids(spark, docs, none, tokenizer):
    rows = planes.round_trip(docs, vocabulary()).collect()
    order = sorted(edge_docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t, *_ in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert planes.round_trip(none, vocabulary()).count() == 0


# 7


PAGE = """<html><head><title>T</title><style>p>a{}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>My site tagline is here</p></header><div id="cookie-notice">We use cookies <a href=x>ok</a></div>
<div class=wrap><div class="content"><h1>Real title</h1><p>First para with <a href="q>r">a link</a> &amp; more&nbsp;text   here to read.<p>Second para 1 &lt; 2, five words more.
<div class="advert">Buy now cheap</div><aside>Side stuff</aside><ul><li>point one is here<li>point two too</ul><!-- gone --><script>if (a<b) "</p>"</script><p>Last.</p></div><div class="sidebar"><p>Recent posts are many and varied</p></div>
<section id="comments"><h2>Comments</h2><p>Great article, I loved all of it really</p></section><form><label>Mail</label><input></form><footer>copyright</footer></body></html>"""


@pytest.mark.parametrize("quote", ["'", '"'])
@pytest.mark.parametrize("size", [8_000, 9_000, 3_000_000])
def test_html_long_attribute_values(quote, size):
    # markup within a quoted value is no text, and attributes after it count, however long the value is
    w, value = html.Weights([]), ("<p>not text a > b</p> " * (size // 20))[:size]
    page = f"<html><body><p>{prose(40, 1)}</p><div data-x = {quote}{value}{quote} class='sidebar'><p>{prose(40, 2)}</p></div><p>{prose(40, 3)}</p></body></html>"
    assert html.main_text(page, w) == prose(40, 1) + "\n" + prose(40, 3)
    assert html.main_text(page.replace(f"{quote} class='sidebar'", quote), w) == "\n".join(prose(40, k) for k in (1, 2, 3))


def test_html_stray_quotes():
    # a quote that nothing closes is stray; many of them take linear time
    w = html.Weights([])
    assert html.main_text(f'<p title="x>{prose(40, 1)}</p><p>{prose(40, 2)}</p>', w) == prose(40, 1) + "\n" + prose(40, 2)
    assert html.main_text("<p a='b' c=" * 300_000 + f"'>{prose(40, 1)}</p>", w).endswith(prose(40, 1))


def test_html(spark):
    want = "Real title\nFirst para with a link & more text here to read.\nSecond para 1 < 2, five words more.\npoint one is here\npoint two too\nLast."
    assert html.main_text(PAGE, html.Weights([])) == want
    nav = "<nav><ul><li><a href=/a>alpha</a><li><a href=/b>beta</a></ul></nav>"
    marked = [(k, f"u{k}", f"<html><body>{nav}<div>menu text outside</div><article><h1>Head {k}</h1><p><b>{prose(30, k)}<br><p>Short.</p></article><div>Unmarked note about things</div></body></html>") for k in range(20)]
    rows = [*marked, (100, None, None), (101, "e", ""), (102, "x", "<p>"), (None, "n", PAGE), (103, "p", "plain words < and & more")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[k].text == f"Head {k}\n{prose(30, k)}\nShort." for k in range(20))
    assert [got[k].text for k in (100, 101, 102)] == ["", "", ""] and got[None].text == want and got[None].n_chars == len(want)
    assert got[103].text == "plain words < and & more"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_names_are_evidence_and_no_veto():
    w, text = html.Weights([]), [prose(30, k) for k in range(3)]
    body = f"<p>{text[0]}</p><p>{text[1]}</p>"
    for name in ("article-share-enabled", "post social-sciences", "layout-sidebar-right", "content has-comments comments-open"):
        assert html.main_text(f'<html><body><div class="{name}">{body}</div></body></html>', w) == "\n".join(text[:2]), name
        assert html.main_text(f'<html><body><div class="{name}"><div class="sidebar">{text[2]}</div>{body}</div></body></html>', w) == "\n".join(text[:2]), name
    # a wrapper of the headline or of the marked content, whatever it is called
    assert html.main_text(f'<div class="sidebar"><h1>Head</h1>{body}</div>', w) == "\n".join(["Head", *text[:2]])
    assert html.main_text(f'<div id="comments"><article class="ad">{body}<div class="share">Share it now</div></article></div>', w) == "\n".join(text[:2])
    assert html.main_text(f'<div class="sidebar">{body}</div>', w) == ""
    # names that no prior knows are learned
    learned = html.Weights([("w:p", 5000, 5000), ("n:zzz", 0, 4000), ("n:qqq", 4000, 0)])
    assert learned["n:zzz"] < -1 and learned["n:qqq"] > 0.4 and learned["n:other"] == 0.0


def test_html_odd_pages():
    w, text = html.Weights([]), prose(30, 1)
    assert html.main_text("<script>" + "\u0130" * 40 + f"</SCRIPT ><p>{text}</p>", w) == text
    assert html.main_text(f"<script>a</scripts></script><p>{text}</p>", w) == text
    assert html.main_text(f"<p>{text} <math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math> end</p><object>{text}</object>", w) == f"{text} x= end\n{text}"
    # an open p ends at the next block, however many inline elements are open within it
    deep = f"<p class='ad'>{'<b>' * 3000}bad<p>{text}</p>"
    assert html.main_text(deep, w) == text
    assert html.main_text("<div>" * 50_000 + f"<p>{text}</p>" + "</span>" * 50_000, w) == text


def test_region_is_the_best_one():
    rng, w = random.Random(1), html.Weights([])
    for _ in range(50):
        events = [("t:" + rng.choice(["p", "div", "a"]), 1, -1, -1) if rng.random() < 0.5 else (rng.choice(["-w:p", "-l:li"]), rng.randint(1, 3), k, -1) for k in range(14)]
        value = [w[k] if k[0] == "t" else w[k[1:]] * n for k, n, *_ in events]
        best = max([sum(value[a : b + 1]) for a in range(14) for b in range(a, 14)] + [0.0])
        a, b = html.region(events, value)
        got = max([sum(value[x : y + 1]) for x in range(14) for y in range(x, 14) if [e[2] for e in events[x : y + 1] if e[2] >= 0][:1] == [a] and [e[2] for e in events[x : y + 1] if e[2] >= 0][-1:] == [b]] + [0.0])
        assert abs(best - got) < 1e-9


# 9


def test_language(spark, docs, none):
    r = random.Random(8)
    sounds = {"en": ["the", "ing", "th", "er", "on"], "de": ["sch", "ung", "ei", "ü", "ch"], "fr": ["eau", "que", "é", "oi", "en"]}
    rows = [(1000 + k, " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(60)), lang, None, 0) for k in range(120) for lang, s in [list(sounds.items())[k % 3]]]
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in langid.predict(df.unionByName(docs.select(*df.columns))).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = {i: lang for i, _, lang, *_ in rows}
    assert held and all(got[i].held_out and got[i].lang_pred == right[i] for i in held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 5, 10)] == [("und", 0.0)] * 4
    assert {x.lang_pred for x in langid.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(none).count() == 0


def test_gram_counts_by_brute_force(monkeypatch):
    texts = ["Ab, ab!", "", "É1é x", "ab"]

    def brute(t):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f"\0{w}\0"
            for n in (1, 2, 3):
                out.update(p[k : k + n] for k in range(len(p) - n + 1) if p[k : k + n].strip("\0") and not (n == 1 and p[k] == "\0") and not (n == 3 and p[k + 1] == "\0"))
        return out

    row, _, count = langid.gram_counts(*buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert sorted(count[row == k].tolist()) == sorted(brute(t).values())
    whole = langid.gram_counts(*buffers(pa.array([prose(300, 4)])))
    monkeypatch.setattr(langid, "SLICE_BYTES", 100)
    parts = langid.gram_counts(*buffers(pa.array([prose(300, 4)])))
    assert all((a == b).all() for a, b in zip(whole, parts))


# 10


def test_fingerprints(spark, docs, none):
    rows = sorted(edge_docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, *_ in rows]
    own = digest.of_texts(texts)
    want = []
    for k, (i, *_) in enumerate(rows):
        then = texts[(k + 1) % len(texts)]
        new = texts[k][: len(texts[k]) - len(texts[k]) // 2] + then[: len(texts[k]) // 2]
        mark = digest.of_texts([new])
        want.append((i, len(texts[k]), hashlib.sha256(new.encode()).hexdigest(), own[k].tobytes().hex(), mark[0].tobytes().hex(), float(digest.likeness(own[k : k + 1], mark)[0]), float(digest.likeness(own[k : k + 1], own[[(k + 1) % len(texts)]])[0])))
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = digest.with_next(docs).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    (one,) = digest.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert digest.with_next(none).count() == 0
    assert digest.fingerprints(docs.select("doc_id", "text")).count() == len(rows)


def test_digests_by_brute_force(monkeypatch):
    # triplets, quartiles and header worked out one by one
    def brute(t):
        raw, count = t.encode(), [0] * 128
        for k in range(len(raw)):
            for x, y, z, odd in ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA77), (0, 2, 3, 0xC2B2AE3D)):
                if k + z < len(raw):
                    h = (raw[k + x] + 256 * raw[k + y] + 65536 * raw[k + z]) * odd % 2**32
                    h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                    count[h >> 25] += 1
        low, mid, high = (sorted(count)[q] for q in (31, 63, 95))
        code = [sum(c > q for q in (low, mid, high)) for c in count]
        body = [code[k] + 4 * code[k + 1] + 16 * code[k + 2] + 64 * code[k + 3] for k in range(0, 128, 4)]
        size = min(int(np.floor(np.log(max(len(raw), 1)) / np.log(1.2))), 255)
        return bytes([zlib.crc32(raw) % 256, size, low * 15 // max(high, 1), mid * 15 // max(high, 1), *body])

    texts = ["", "a", "ab", "abc", "abcd", "É中😀", prose(5, 1), prose(300, 2), "x" * 5000]
    for most in (digest.SLICE_BYTES, 100):  # also where a text is longer than a slice
        monkeypatch.setattr(digest, "SLICE_BYTES", most)
        assert [r.tobytes() for r in digest.of_texts(texts)] == [brute(t) for t in texts]
    a, b = digest.of_texts([prose(200, 1), prose(200, 2)])
    far = int(a[0] != b[0]) + (lambda d: d if d <= 1 else min(2 * d, 40))(abs(int(a[1]) - int(b[1]))) + sum(min(2 * abs(int(x) - int(y)), 12) for x, y in zip(a[2:4], b[2:4]))
    for x, y in zip(a[4:].tolist(), b[4:].tolist()):
        for k in (0, 2, 4, 6):
            d = abs((x >> k & 3) - (y >> k & 3))
            far += 6 if d == 3 else d
    assert abs(digest.likeness(a[None], b[None])[0] - max(0.0, 1 - far / 240)) < 1e-12


def test_likeness_falls_with_edits():
    a = prose(500, 1)
    words = a.split()
    marks = []
    for share in (0, 10, 50, 500):
        w = list(words)
        w[:share] = prose(share, 77).split() if share else []
        marks.append(" ".join(w))
    near = digest.likeness(digest.of_texts([a] * 4), digest.of_texts(marks))
    # all words are of one vocabulary, so that even other texts share triplets
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.7


def test_bucket_counts_of_long_rows(monkeypatch):
    data, offsets = buffers(pa.array([prose(200, 1), "ab", prose(100, 2)]))
    whole = digest.bucket_counts(data, offsets)
    monkeypatch.setattr(digest, "SLICE_BYTES", 64)
    assert (digest.bucket_counts(data, offsets) == whole).all() and whole[1].sum() == 0


def test_lm_hash_partitions_follow_the_slices(spark, monkeypatch):
    """Where the session's shuffle partitions are few, hash partitions are not: a task holds one of them."""
    from srcatlas.llm import lm

    seen, real, before = [], lm.known_words, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lm, "known_words", lambda files, folder, parts: (seen.append(parts), real(files, folder, parts))[1])
    docs = spark.range(60).selectExpr("id as doc_id", "concat('w', id % 7, ' a b') as text").repartition(12)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert lm.score(docs).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] >= 12


def test_lm_slices_bound_their_rows(spark, monkeypatch):
    """Short and empty texts do not make slices of more rows than a worker holds, and no row is lost or scored otherwise."""
    docs = spark.range(100).selectExpr("id as doc_id", "case when id % 3 = 0 then '' else concat('w', id % 7, ' a b') end as text").coalesce(1)
    listed = lambda df: sorted(map(tuple, df.collect()))
    whole, seen, real = listed(lm.score(docs)), [], lm.known_words
    monkeypatch.setattr(lm, "MOST_ROWS", 8, raising=False)
    monkeypatch.setattr(lm, "known_words", lambda files, folder, parts: (seen.extend(lm.opened(folder, r["file"])[0].num_rows for r in files.collect()), real(files, folder, parts))[1])
    found = listed(lm.score(docs))
    assert max(seen) <= 8 and sum(seen) == 100
    assert [r[:5] for r in found] == [r[:5] for r in whole] and np.allclose([r[5:8] for r in found], [r[5:8] for r in whole])
