"""Links of the Jaccard join, each counted, beside every pair of rows."""

import collections
import random

import numpy as np
import pytest

from tests.llm.rows import awkward, frame, lower, words
from tidemark.llm.jaccard_join import jaccard_links, needed_overlap, trie_join


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_links(rows):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            o = len(a & b)
            if o and 100 * o >= 80 * (len(a) + len(b) - o):
                links[i] += 1
                links[j] += 1
    return collections.Counter((r[0], len(s), n) for r, s, n in zip(rows, sets, links))


def near_copies(n):
    """Texts of one long passage, each with words of its own at the end: all resemble each other."""
    r = random.Random(3)
    passage = [f"p{r.randrange(10_000)}" for _ in range(120)]
    return [(i, " ".join([*passage, *[f"own{i}x{k}" for k in range(i % 4)]])) for i in range(n)]


@pytest.mark.parametrize("cell", [4, 4000])
def test_every_link_is_counted(spark, cell):
    rows = awkward() + [(5000 + i, t) for i, t in near_copies(15)]
    got = collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in jaccard_links(frame(spark, rows), cell=cell).collect())
    assert got == plain_links(rows)


def test_trie_join_finds_every_pair():
    r = random.Random(4)
    for _ in range(60):
        sets = []
        for _ in range(r.randint(1, 25)):
            s = set(r.choice(sets).tolist()) if sets and r.random() < 0.7 else {r.randrange(60) for _ in range(r.randint(0, 20))}
            for _ in range(r.randint(0, 3)):
                s ^= {r.randrange(60)}
            sets.append(np.array(sorted(s), np.int64))
        sizes, side = [len(s) + r.choice([0, 0, 1]) for s in sets], np.array([r.randrange(2) for _ in sets])
        want = {(a, b) for a in range(len(sets)) for b in range(a) if sizes[a] and sizes[b] and len(np.intersect1d(sets[a], sets[b])) >= needed_overlap(sizes[a], sizes[b])}
        assert {(max(p), min(p)) for p in trie_join(sets, sizes)} == want
        assert {(max(p), min(p)) for p in trie_join(sets, sizes, sides=side)} == {(a, b) for a, b in want if side[a] != side[b]}


def test_texts_without_an_id_link(spark):
    a = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(a + [f"x{k}" for k in range(26)])), (None, " ".join(a + [f"x{k}" for k in range(10)])), (2, " ".join(a)), (None, "alone and without a name")]
    got = collections.Counter((r.doc_id, r.n_links, r.component_id) for r in jaccard_links(frame(spark, rows)).collect())
    links = collections.Counter((i, n) for i, _, n in plain_links(rows).elements())
    assert collections.Counter((i, n) for i, n, _ in got.elements()) == links
    assert got == {(1, 1, 1): 1, (None, 2, 1): 1, (2, 1, 1): 1, (None, 0, None): 1}
