"""Embedding links, source divergence and filter interaction beside plain versions on awkward rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.rows import awkward, frame, words
from tidemark.llm import source_divergence as S
from tidemark.llm.embedding_dedup import budgets, embedding_links, linked, turned
from tidemark.llm.filter_audit import ORDERS, filter_audit, outcomes
from tidemark.llm.source_divergence import source_divergence

# ---- embeddings


def vectors(seed=3, n=150, dim=20):
    """(vec_id, embedding, label): clusters, equal, scaled and opposite vectors, and all that has no direction."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = centres[r.integers(6)] if i % 3 else r.normal(size=dim)
        v = c + r.normal(size=dim) * [0.05, 0.2, 0.3, 0.4][i % 4] * np.abs(c).mean()
        rows.append((int(1000 + (i * 37) % 911), v.tolist(), [0, 0, 0, 1, None][i % 5]))
    v = rows[1][1]
    rows += [(5, [1e-200 * x for x in v], 0), (6, [1e200 * x for x in v], 0), (7, [-x for x in v], 0), (8, v, 1), (9, v, None), (None, v, 0), (None, rows[4][1], 1)]
    rows += [(20 + k, list(v), 0) for k in range(40)] + [rows[10], rows[10], rows[11]]
    odd = [None, [], [0.0] * dim, [None] + v[1:], [math.nan] + v[1:], [math.inf] + v[1:], v[:7], v[:7], [0.93, math.sqrt(1 - 0.93**2)], [1.0, 0.0], [2.0], [3.0]]
    rows += [(3000 + k, x, 0) for k, x in enumerate(odd)]
    return rows


def plain_links(rows, least=0.93):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = []
    for _, v, label in rows:
        if label is None or not good(v):
            unit.append(None)
            continue
        w = np.ldexp(np.array(v), -math.frexp(max(map(abs, v)))[1])
        unit.append(w)
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = unit[i], unit[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
            if (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())) >= least:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, len(links[i]), low, vec_id == low))
    return collections.Counter(out)


@pytest.mark.parametrize("most, width", [(4096, 8), (7, 3)])
def test_embedding_links(spark, most, width):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, size int")
    got = collections.Counter(tuple(r) for r in embedding_links(df, most=most, width=width).collect())
    assert got == plain_links(rows)
    assert embedding_links(df.limit(0)).count() == 0


def test_blocks_lose_no_pair():
    """Each pair within reach is found under exactly one block, and rotation changes no length."""
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 64))
    v = np.repeat(v[:60], 5, axis=0) + 0.2 * v
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    x = turned(unit)
    assert np.allclose(x @ x.T, unit @ unit.T) and (turned(unit[7:9]) == x[7:9]).all()
    found = collections.Counter()
    for block in range(len(budgets(64, 0.93))):
        for s, t in linked(x, x, block, 0.93):
            found.update(zip(s.tolist(), t.tolist()))
    i, j = np.nonzero(unit @ unit.T >= 0.93)
    assert set(found.values()) == {1} and set(found) == set(zip(i.tolist(), j.tolist()))


# ---- divergence


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_divergence(rows, best):
    docs = [(lang or "", source or "", plain_terms(text)) for text, lang, source in rows]
    out = collections.Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(w for _, _, t in mine for w in set(t))
        kept = sorted((w for w, n in df.items() if n >= 3), key=str.encode)
        counts = {s: collections.Counter() for _, s, _ in mine}
        for _, s, t in mine:
            counts[s].update(w for w in t if df[w] >= 3)
        total = sum(counts.values(), collections.Counter())
        share = lambda c: {w: 1 + (10**9 * (c[w] + 1)) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out.update((lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1))
    return out


def spoken(rows):
    r = random.Random(2)
    out = [(t, r.choice(["en", "de", None]), r.choice(["a", "B", "é", "", None])) for _, t in rows]
    return out + [("Ab aB AB\x00ab ab1ab ÄÄ ää ÄÄ zz", "xx", s) for s in ("p", "q", "p", "p")] + [("only", "solo", "one"), (None, "mute", "m"), ("", "mute", "n")]


@pytest.mark.parametrize("cells, best", [(1 << 19, 200), (60, 4)])
def test_source_divergence(spark, cells, best):
    rows = spoken(awkward())
    df = spark.createDataFrame([(k % 9, *r, "x", 3, b"t") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, item string, rank int, term binary")
    got = collections.Counter(tuple(r) for r in source_divergence(df, cells=cells, best=best).collect())
    assert got == plain_divergence(rows, best)
    assert source_divergence(df.limit(0)).count() == 0


def test_long_texts_count_once(monkeypatch):
    """A text that is cut in pieces gives the counts of a whole one; a word longer than a piece stays whole."""
    monkeypatch.setattr(S, "SLICE", 50)
    texts = ["", "ab cd " * 40 + "Ä" * 120 + " ab", "x", None, "y" * 400, "ab cd", "cd"]
    text = pa.array([t or "" for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(["s", "s", "t", "t", "s", "t", "t"]), text], ["lang", "source", "text"]).slice(1)
    n, docs = collections.Counter(), collections.Counter()
    for b in S._tally(iter([batch])):
        for r in b.to_pylist():
            if r["term"] is not None:
                n[r["source"], r["term"].decode()] += r["n"]
                docs[r["source"], r["term"].decode()] += r["docs"]
    want_n, want_docs = collections.Counter(), collections.Counter()
    for s, t in zip("sttstt", texts[1:]):
        want_n.update((s, w) for w in plain_terms(t))
        want_docs.update((s, w) for w in set(plain_terms(t)))
    assert n == want_n and docs == want_docs


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(300):
        total = r.randrange(1, 9 * 10**15)
        c = r.randrange(0, total)
        assert S.shares(np.array([c]), np.array([total]))[0] == 1 + 10**9 * (c + 1) // total


# ---- filters


def plain_audit(rows, labels):
    """The five filters, run one after the other in each order over the documents themselves."""
    smaller = lambda i, t: i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
    fails = []
    for i, t, _ in rows:
        w, t = words(t), t or ""
        bad = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller(i, t)]
        fails.append({f for f, b in zip("ABCDE", bad) if b})
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = collections.Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        lines, credit = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            live = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in live if f in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                live = [d for d in live if f not in d[1]]
                credit[f] += len(gone)
                lines.append((order, step, f, len(live), len(gone), redundant, sum(d[1] == {f} for d in mine), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out.update((part, o, s, *rest, credit[f]) for o, s, f, *rest in lines)
    return out


def test_filter_audit(spark):
    texts = awkward(n=80) + [(2000 + k, "SHOUT " * (k % 60) + "#" * (k % 2)) for k in range(30)] + [(50 - k, "same text again") for k in range(20)] + [(31, "same text again")] * 2
    rows = [(i, t, [None, "", "a", "b"][k % 4]) for k, (i, t) in enumerate(texts)]
    labels = [(i, k % 2, k % 3 % 2) for k, (i, _, _) in enumerate(rows) if k % 2] + [(31, 0, 1), (31, 1, 0), (None, 1, 1), (4, None, None), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "doc_id long, text string, source string, part string, mask int, first string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = collections.Counter(tuple(r) for r in filter_audit(docs, marks).collect())
    assert got == plain_audit(rows, labels)
    assert filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit(docs, marks.limit(0)).count() == 600 * 3


def test_outcomes_add_up():
    r = np.random.default_rng(0)
    counts = r.integers(0, 100, (3, 32))
    got = outcomes(counts, counts, counts)
    removed = got["removed"].reshape(3, len(ORDERS), 5)
    assert (removed.sum(2) + got["kept"].reshape(3, len(ORDERS), 5)[:, :, -1] == counts.sum(1)[:, None]).all()
    assert (got["shapley"].reshape(3, len(ORDERS), 5).sum(2) == len(ORDERS) * (counts.sum(1) - counts[:, 0])[:, None]).all()
