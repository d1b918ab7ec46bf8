"""Scores of higher orders beside a plain trie."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import awkward, frame
from tidemark.llm import ppm
from tidemark.llm.ppm import ORDER, lm_scores, score_texts


def plain(rows, learnt, order):
    trie = defaultdict(lambda: defaultdict(int))
    for (_, t), x in zip(rows, learnt):
        b = [256] * order + list((t or "").encode()) + [256]
        for k in range(order, len(b) if x else 0):
            for o in range(order + 1):
                trie[tuple(b[k - o : k])][b[k]] += 1

    def score(t):
        b, total = [256] * order + list((t or "").encode()) + [256], 0.0
        for k in range(order, len(b)):
            out, p = set(), 1.0
            for o in range(order, -1, -1):
                c = {x: m for x, m in trie.get(tuple(b[k - o : k]), {}).items() if x not in out}
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

    return [score(t) for _, t in rows]


@pytest.mark.parametrize("order", [3, ORDER])
def test_scores_of_order(spark, order):
    rows = [(i, t) for i, (_, t) in enumerate(awkward(n=40))] + [(900, bytes(range(128)).decode()), (901, "né w1 w2")]
    got = {r.doc_id: r.score for r in score_texts(frame(spark, rows), F.col("doc_id") % 3 != 0, order=order).collect()}
    want = plain(rows, [i % 3 != 0 for i, _ in rows], order)
    for (i, _), w in zip(rows, want):
        assert got[i] == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_query_tells_phrases_from_their_trigrams(spark):
    learnt = [(i, "abcdexabcdeyabcdez") for i in range(40)]
    rows = learnt + [(100 + i, "abcdexabcdey" if i % 2 else "cdexabcdeyab"[::-1]) for i in range(20)]
    got = lm_scores(frame(spark, rows)).collect()
    held = {r.doc_id for r in got if r.held_out}
    want = dict(zip([i for i, _ in rows], plain(rows, [i not in held for i, _ in rows], ORDER)))
    assert all(r.score == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9) for r in got)


def test_slices_change_nothing(monkeypatch):
    texts, train = [b"ab" * 400, b"", b"abc", "né".encode() * 50], np.array([True, True, False, True])
    whole = ppm._distinct_grams(texts, train, ORDER)
    monkeypatch.setattr(ppm, "SLICE_BYTES", 3)
    assert all((a == b).all() for a, b in zip(whole, ppm._distinct_grams(texts, train, ORDER)))


def test_long_text_and_empty_table(spark):
    rows = [(1, "ab " * 1_000_000), (4, "ab"), (2, None)]
    got = {r.doc_id: r for r in lm_scores(frame(spark, rows)).collect()}
    assert got[1].n_tokens == 1_000_001 and 0 > got[1].score > -500_000
    assert lm_scores(frame(spark, rows).limit(0)).count() == 0


def test_probabilities_of_texts_add_up(spark):
    """After any context the probabilities of all symbols, the end among them, have sum 1."""
    texts = [b"", b"a", b"ab", b"b", b"ba"]
    keys, _ = ppm.gram_keys(texts * 3, 2)
    names, counts = np.unique(np.concatenate([keys, ppm.gram_keys([bytes([x]) for x in range(256)], 2)[0]]), return_counts=True)
    learnt = np.array([(keys == k).sum() for k in names])
    pairs, _ = ppm.gram_keys(texts * 3, 1)
    c1 = np.zeros((257, 257), np.int64)
    np.add.at(c1, (pairs >> 9, pairs & 511), 1)
    logs = ppm.gram_logs(names, learnt, 2, c1)
    start = names >> 9 == (256 << 9 | 256)
    assert start.sum() == 257 and (10 ** logs[start]).sum() == pytest.approx(1)
