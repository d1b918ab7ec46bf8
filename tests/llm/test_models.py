"""Toxicity, language-model scores and byte BPE: held-out accuracy, brute force, exact round trips."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.rows import awkward, frame, lower, words
from tidemark.llm import byte_bpe as B
from tidemark.llm.ppm import score_texts
from tidemark.llm.queries import rank_path
from tidemark.llm.toxicity import Ftrl, drop_toxic, feature_slots, fold, toxicity_scores

ROWS = awkward()


# ---- toxicity


def test_features_match_plain_count():
    texts = ["a b c", "", "A b, c!", "é é é é", "x"]
    of, slots = feature_slots([t.encode() for t in texts], 18)
    sets = [set(slots[of == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[2] and len(sets[0]) == 3 + 2 + 1
    assert sets[1] == set() and len(sets[3]) == 3 and len(sets[4]) == 1


def test_ftrl_is_sparse():
    r, m = np.random.default_rng(1), Ftrl(10)
    for _ in range(1500):
        y = int(r.random() < 0.3)
        m.learn(np.unique(np.append(r.integers(2, 1024, 12), [0] * y).astype(int)), float(y))
    w = m.weights(np.arange(1024))
    assert w[0] > 1 and (w != 0).mean() < 0.2


@pytest.fixture(scope="module")
def toxic_docs(spark):
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(400)]
    bad = ["nasty", "awful", "vile"]
    rows = []
    for i in range(1500):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        y = int(r.random() < 0.25)
        for _ in range(2 * y):
            w.insert(r.randrange(len(w)), r.choice(bad).upper() + r.choice([",", ""]))
        rows.append((i, " ".join(w), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (None, "w1 vile vile nasty")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, None, 1)], "doc_id long, toxic int, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_held_out(toxic_docs):
    docs, labels, truth = toxic_docs
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 1503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    blank = {r.doc_id: r.predicted for r in got if r.doc_id in (2000, 2001)}
    assert blank == {2000: 0, 2001: 0}


def test_toxicity_learns_from_its_fold_only(toxic_docs):
    docs, labels, _ = toxic_docs
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity_scores(docs, turned).collect()}
    left = drop_toxic(docs.withColumn("score", F.lit("kept")), labels)
    assert left.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in left.collect()} == {i for i, s in a.items() if s < 0.5}


def plain_ftrl(texts, labels, bits, epochs, l1):
    """The update written out coordinate by coordinate: alpha = beta = 1, no L2, the bias without L1."""
    z, n, zb, nb = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    w = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / (1 + math.sqrt(n[k]))
    bias = lambda: -zb / (1 + math.sqrt(nb))
    rows = [(sorted(set(feature_slots([t.encode()], bits)[1].tolist())), y) for t, y in zip(texts, labels)]
    for _ in range(epochs):
        for slots, y in rows:
            g = 1 / (1 + math.exp(-(sum(map(w, slots)) + bias()))) - y
            old = {k: w(k) for k in slots}
            for k in slots:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * old[k]
                n[k] += g * g
            b = bias()
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) * b
            nb += g * g
    return {k: w(k) for k in z if abs(z[k]) > l1}, bias()


def test_ftrl_is_the_plain_update(spark, toxic_docs):
    from tidemark.llm.toxicity import score, train

    docs, labels, truth = toxic_docs
    some = docs.where("doc_id < 120").select("doc_id", "text").join(labels.select("doc_id", "toxic").where("toxic is not null"), "doc_id")
    for l1 in (0.5, 2.0):
        got = {r.slot: r.weight for r in train(some, "doc_id", "text", "toxic", bits=14, epochs=3, l1=l1).collect()}
        rows = some.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").collect()
        want, bias = plain_ftrl([r.text for r in rows], [r.toxic for r in rows], 14, 3, l1)
        assert got.pop(-1) == pytest.approx(bias) and got.keys() == want.keys() and len(want) > 0
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        weights = train(some, "doc_id", "text", "toxic", bits=14, epochs=3, l1=l1)
        for r in score(some, weights, bits=14).limit(20).collect():
            x = bias + sum(want.get(k, 0.0) for k in set(feature_slots([r.row.text.encode()], 14)[1].tolist()))
            assert r.score == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-5)


def test_settings_are_chosen_without_the_held_out_fold(toxic_docs):
    from tidemark.llm.toxicity import cross_validate

    docs, labels, _ = toxic_docs
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    grid = [{"l1": 1.0, "bits": 16}, {"l1": 500.0, "bits": 16}]
    a, b = cross_validate(docs, labels, grid, folds=(1, 2)), cross_validate(docs, turned, grid, folds=(1, 2))
    assert a == b and a[0]["loss"] < a[1]["loss"] and a[0]["rows"] > 400


def test_long_texts_and_the_bound_on_bytes(spark, toxic_docs):
    from tidemark.llm.toxicity import train

    docs, labels, _ = toxic_docs
    long = spark.createDataFrame([(9000, "w1 vile w2 " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity_scores(docs.unionByName(long), labels.unionByName(spark.createDataFrame([(9000, 1, 0)], labels.schema))).collect()}
    assert 0 <= got[9000] <= 1
    some = docs.join(labels.where("toxic is not null"), "doc_id")
    order = [r.text for r in some.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").collect()]
    size = sum(map(len, order[:100]))
    a = train(some, "doc_id", "text", "toxic", bits=12, l1=1.0, max_bytes=size).collect()
    b = train(some, "doc_id", "text", "toxic", bits=12, l1=1.0, max_rows=100).collect()
    assert sorted(a) == sorted(b)


def test_a_text_that_does_not_fit_is_passed_over(spark, toxic_docs):
    """The first text in the order of learning is larger than the bound: all others are learnt from, as if it were not there."""
    from tidemark.llm.toxicity import drop_toxic, train

    docs, labels, _ = toxic_docs
    some = docs.join(labels.where("toxic is not null"), "doc_id").select("doc_id", "text", "toxic")
    first = some.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").first().doc_id
    grown = some.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("vile w1 é "), 200_000)).otherwise(F.col("text")))
    a = train(grown, "doc_id", "text", "toxic", bits=12, l1=1.0, max_bytes=1_500_000).collect()
    b = train(some.where(F.col("doc_id") != first), "doc_id", "text", "toxic", bits=12, l1=1.0).collect()
    assert sorted(a) == sorted(b) and len(a) > 5
    rows = grown.select("doc_id", "text")
    kept = drop_toxic(rows, labels).count()
    assert 0.4 * rows.count() < kept < rows.count()


def test_nothing_learnt_drops_nothing(spark, toxic_docs):
    from tidemark.llm.toxicity import drop_toxic

    docs, labels, _ = toxic_docs
    every = labels.select("doc_id", F.lit(1).alias("toxic"))
    same = docs.select("doc_id", F.lit("one text for all").alias("text"))
    assert drop_toxic(same.limit(3), every).count() == 3
    assert drop_toxic(same.limit(3), every.limit(0)).count() == 3


def test_toxicity_without_labels(spark):
    got = toxicity_scores(frame(spark, ROWS), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(ROWS) and {r.score for r in got} == {0.5}
    assert toxicity_scores(frame(spark, ROWS).limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


# ---- language model


def plain_scores(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    toks = lambda t: [*words(lower(t or "")), None]
    count, trie = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(3)]
    for i, t in rows:
        if not held[i]:
            count.update(toks(t))
            b = [256, 256, *(t or "").encode(), 256]
            for k in range(2, len(b)):
                for o in range(3):
                    trie[o][tuple(b[k - o : k])][b[k]] += 1
    n, v = sum(count.values()), len(count)

    def ppm(t):
        b, total = [256, 256, *(t or "").encode(), 256], 0.0
        for k in range(2, len(b)):
            out, p = set(), 1.0
            for o in (2, 1, 0):
                c = {x: m for x, m in trie[o].get(tuple(b[k - o : k]), {}).items() if x not in out}
                if not c:
                    continue
                size = sum(c.values()) + (len(c) if 257 - len(out) > len(c) else 0)
                if b[k] in c:
                    p *= c[b[k]] / size
                    break
                p *= len(c) / size
                out |= set(c)
            else:
                p /= 257 - len(out)
            total += math.log10(p)
        return total

    return [(i, held[i], len(toks(t)), sum(count[w] > 0 for w in toks(t)), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), ppm(t)) for i, t in rows]


def lm(df):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_texts(df, ~held)


def test_lm_scores(spark):
    got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm(frame(spark, ROWS)).collect()), key=repr)
    want = sorted(plain_scores(ROWS), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_lm_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(df, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(3 * math.log10(1 / 257)) and got[2].score == pytest.approx(math.log10(1 / 257))
    assert got[1].train_tokens == 0 and got[1].n_known == 0
    assert score_texts(df.limit(0), F.lit(True)).count() == 0


# ---- byte BPE


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.rank_bytes(rank_path()))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_matches_library(codec, reference):
    r = random.Random(4)
    letters = "  ''\n\t\r\x0b  stremlvdSTMabz09é½ñ٣中😀́!?#-_\0\x7f\x85​　"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["", "a" * 3000, " " * 2000, "ab" * 500, "'s't're'", "  's", "x 's", " ''s", "'seven", "'Re're\n's", "\n\n a", "a\n", "a \n "]
    got = [y for lo in range(0, len(texts), 500) for y in codec.encode(texts[lo : lo + 500])]
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
        assert codec.decode(g) == t.encode()


def test_bpe_block_edges(codec, reference):
    for n in range(B.BLOCK - 3, B.BLOCK + 4):
        for tail in ("'re x", "  y", " 's", "s'll!", "\n\n"):
            t = "a" * (n - 2) + tail
            assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_bpe_long_merge_is_the_same(codec):
    r = random.Random(6)
    for _ in range(200):
        ids = [codec.byte_ids[r.randrange(97, 101)] for _ in range(r.randint(1, 64))]
        assert B._merge_short(list(ids), codec.pairs) == B._merge_long(list(ids), codec.pairs)


def test_bpe_very_long_piece(codec, reference):
    for t in ("ab" * 2_000, "é" * 1_500, "=" * 3_000):
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)
    t = "ab" * 200_000  # beyond what the library merges in reasonable time
    assert codec.decode(codec.encode([t])[0]) == t.encode()


def test_bpe_offsets(codec):
    t = "Hé it's 12  x"
    raw = t.encode()
    at = [*codec.offsets(t), len(raw)]
    assert b"".join(raw[a:b] for a, b in zip(at, at[1:])) == raw and [raw[a:b] for a, b in zip(at, at[1:])][:4] == ["Hé".encode(), b" it", b"'s", b" 12"]


def test_bpe_query(spark, reference):
    got = collections.Counter(tuple(r) for r in B.bpe_digest(frame(spark, ROWS), rank_path()).collect())
    want = collections.Counter()
    for i, t in ROWS:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    both = B.decode_ids(B.encode_texts(frame(spark, ROWS), rank_path()), rank_path())
    assert both.where(F.col("decoded") != F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")).count() == 0
    assert B.bpe_digest(frame(spark, ROWS).limit(0), rank_path()).count() == 0
    with pytest.raises(ValueError):
        B.bpe_digest(frame(spark, ROWS), rank_path(), pattern=r"\w+")


def test_pattern_is_the_vocabulary_s():
    assert B.PATTERN == public_tokenizers.PATTERN
