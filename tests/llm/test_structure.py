"""WARC round trips, repeated lines, the Jaccard join and the pipeline against plain Python."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.rows import awkward, frame, lower, words
from tidemark.llm import warc as Q
from tidemark.llm.jaccard_join import jaccard_links, keep_one, needed_overlap, trie_join
from tidemark.llm.line_dedup import clean_lines, drop_repeated_lines, line_digest, repeated_runs, shortest_runs
from tidemark.session import fresh_path

ROWS = awkward()


# ---- WARC


def pages(spark):
    big = "é" * 40_000 + "WARC/1.1\r\n\r\nWARC-Type: response\r\n" + "z" * 70_000
    rows = [(5, "http://a/ b", big), (3, None, big), (9, "u", None), (8, "u", ""), (7, "u", "short"), (6, "u", "short"), (4, "u", "x" * 100), (2, "u", "x" * 100), (10, "ü\r\nX: y", "x" * 100), (None, "n", "x" * 100), (2, "again", "x" * 100), (11, "u", "x" * 99), (12, "u", "x" * 99)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, data string, chunk_no int")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.warc_round_trip(df).collect())
    want = collections.Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        first = min((j for j, _, x in rows if j is not None and (x or "").encode() == raw), default=None)
        again = i is not None and len(raw) >= 100 and first < i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want
    assert Q.warc_round_trip(df).where("not digest_ok").count() == 0
    assert Q.warc_round_trip(df.limit(0)).count() == 0


def test_warc_archives_are_warc(spark):
    rows, df = pages(spark)
    folder = fresh_path(spark, "warc-test")
    none = spark.createDataFrame([], "page_id long, refers_to long")
    paths = [r.path for r in Q.write_archives(Q.chunk_records(df, none).coalesce(2), folder).collect()]
    raw = b"".join(gzip.open(p.removeprefix("file://")).read() for p in paths)
    stream, bodies = io.BytesIO(raw), collections.Counter()
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (h := stream.readline()) != b"\r\n":
            k, _, v = h.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        bodies[stream.read(int(head["Content-Length"]))] += 1
        assert stream.read(4) == b"\r\n\r\n"
    assert bodies == collections.Counter((t or "").encode() for _, _, t in rows)


def test_warc_chunks_carry_digests(spark):
    _, df = pages(spark)
    none = spark.createDataFrame([], "page_id long, refers_to long")
    manifest = Q.write_archives(Q.chunk_records(df, none), fresh_path(spark, "warc-test"))
    chunks = collections.defaultdict(list)
    for r in Q.read_archives(spark, manifest).where("page_id = 5").collect():
        chunks[r.record_id].append(r)
    (rows,) = chunks.values()
    rows.sort(key=lambda r: r.chunk_no)
    assert len(rows) == 3 and max(len(r.data) for r in rows) == Q.CHUNK
    so_far = b""
    for r in rows:
        so_far += r.data
        assert r.running_digest == hashlib.sha256(so_far).hexdigest() and r.is_last == (len(so_far) == r.payload_bytes)


# ---- repeated lines


def test_long_record_is_never_whole(spark):
    """Chunks of a 20 MB payload: none is larger than CHUNK and each carries the digest so far."""
    body = "0123456789abcdef" * 1_300_000
    df = spark.createDataFrame([(1, "u", body), (2, "u", body)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "page_id long, refers_to long")
    rows = Q.chunk_records(df.where("page_id = 1"), none).select("chunk_no", F.octet_length("data").alias("n"), "running_digest").collect()
    so_far = hashlib.sha256()
    for r in rows:
        so_far.update(body[r.chunk_no * Q.CHUNK : (r.chunk_no + 1) * Q.CHUNK].encode())
        assert r.n <= Q.CHUNK and r.running_digest == so_far.hexdigest()
    got = {r.page_id: r for r in Q.warc_round_trip(df).collect()}
    assert got[1].payload_bytes == len(body) and got[1].payload_digest == so_far.hexdigest() == got[2].payload_digest
    assert (got[2].record_type, got[2].refers_to, got[1].digest_ok, got[2].digest_ok) == ("revisit", 1, True, True)


def test_sizes_and_digests_are_counted(spark):
    """A reader believes what it reads, not what the header says."""
    raw = Q.record_header(7, "u", None, 5, "0" * 64) + b"hello\r\n\r\n"
    (row,) = list(Q.read_archive(io.BytesIO(gzip.compress(raw))))
    assert row[7] == 5 and row[8] == hashlib.sha256(b"hello").hexdigest() != row[9]


def test_cut_archives_are_errors(spark):
    """An archive that ends early, anywhere, is never read as a shorter one."""
    one, two = (gzip.compress(Q.record_header(k, "u", None, 5, "0" * 64) + b"hello\r\n\r\n") for k in (7, 8))
    assert len(list(Q.read_archive(io.BytesIO(one + two)))) == 2
    for cut in (1, 5, 20, 60, len(two) - 1):
        with pytest.raises(ValueError):
            list(Q.read_archive(io.BytesIO(one + two[:cut])))
    plain = Q.record_header(7, "u", None, 5, "0" * 64) + b"hello\r\n\r\n"
    for cut in (10, len(plain) - 6, len(plain) - 2):
        with pytest.raises(ValueError):
            list(Q.read_archive(io.BytesIO(one + gzip.compress(plain[:cut]))))
    _, df = pages(spark)
    manifest = Q.write_archives(Q.chunk_records(df, spark.createDataFrame([], "page_id long, refers_to long")), fresh_path(spark, "warc-cut")).collect()
    short = spark.createDataFrame([(r.path, r.records + 1) for r in manifest], "path string, records long")
    with pytest.raises(Exception, match="records of"):
        Q.read_archives(spark, short).count()


def brute_lines(docs, least):
    seen, removed = set(), {}
    for i, t in docs:
        lines = [(n, x) for n, x in enumerate(t.split("\n")) if words(x)]
        size, gone = [len(words(x)) for _, x in lines], set()
        for a in range(len(lines)):
            total, key = 0, []
            for b in range(a, len(lines)):
                total += size[b]
                key.append(lines[b][1])
                if total >= least:
                    if tuple(key) in seen:
                        gone |= {n for n, _ in lines[a : b + 1]}
                    else:
                        seen.add(tuple(key))
        removed[(i, t)] = sorted(gone)
    return removed


@pytest.mark.parametrize("least", [3, 12, 50])
def test_repeated_lines(spark, least):
    # one text an id, so that the order of documents is the order of ids
    ids = collections.Counter(i for i, _ in set(ROWS))
    rows = [(i, t) for i, t in ROWS if ids[i] == 1]
    r = random.Random(8)
    rows += [(5000 + k, "\n".join(r.choice(["p q r", "s t u v", "x", "", "p q r"]) for _ in range(12))) for k in range(25)]
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    want = brute_lines(docs, least)
    got = clean_lines(frame(spark, rows), min_words=least).select("row.doc_id", "row.text", "clean", "removed").collect()
    assert len(got) == len(rows)
    for g in got:
        gone = want[(g.doc_id, g.text or "")]
        assert g.removed == gone, (g.doc_id, g.text)
        left = "\n".join(x for n, x in enumerate((g.text or "").split("\n")) if n not in gone)
        assert (g.clean or "") == (left if gone else (g.text or ""))


def test_repeated_runs_are_maximal(spark):
    p = [f"p{k} " * 10 for k in range(9)]
    q = [f"q{k} " * 10 for k in range(7)]
    rows = [(1, "\n".join(["head", *p, "tail"])), (2, "\n".join([*q, "x"])), (3, "\n".join(["y", *p[1:], "z", "", *q[:6]])), (4, "\n".join(p[:4])), (5, None)]
    got = sorted(tuple(r) for r in repeated_runs(frame(spark, rows)).collect())
    assert got == [(3, 1, 8, 8, 1), (3, 11, 16, 6, 2)]
    assert repeated_runs(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_of_long_texts(spark):
    """Many lines removed from one long document."""
    text = "\n".join(f"line {i} of a long document with some more words in it" for i in range(20_000))
    got = {r.doc_id: r for r in line_digest(frame(spark, [(1, text), (2, "own\n" + text + "\nend")])).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 20_000)
    assert got[2].text_sha256 == hashlib.sha256(b"own\nend").hexdigest()


def test_shortest_runs_cover_maximal_runs():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 14)
        at = np.cumsum([r.choice([1, 1, 1, 2]) for _ in range(n)])
        w = np.array([r.randint(1, 9) for _ in range(n)])
        runs = shortest_runs(at, w, 12)
        assert all(w[a : b + 1].sum() >= 12 and (np.diff(at[a : b + 1]) == 1).all() for a, b in runs)
        for a in range(n):
            for b in range(a, n):
                if (np.diff(at[a : b + 1]) == 1).all() and w[a : b + 1].sum() >= 12:
                    assert set(range(a, b + 1)) == set().union(*[set(range(x, y + 1)) for x, y in runs if a <= x and y <= b])


def test_drop_repeated_lines(spark):
    p = " ".join(f"w{k}" for k in range(60))
    df = frame(spark, [(1, f"{p}\nown one"), (2, f"{p}\nown two"), (3, p), (4, None), (5, ""), (6, f"{p}\n \n{p}")])
    got = {r.doc_id: (r.text, r.n_chars) for r in drop_repeated_lines(df).collect()}
    assert got == {1: (f"{p}\nown one", len(p) + 8), 2: ("own two", 7), 4: (None, 0), 5: ("", 0)}
    assert drop_repeated_lines(df).columns == df.columns
    assert line_digest(df.limit(0)).count() == 0


# ---- Jaccard join


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [4000, 7])
def test_jaccard_components(spark, cell):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_links(frame(spark, ROWS), cell=cell).collect())
    assert got == plain_components(ROWS)


def plain_kept(rows):
    """Rows of the document that each component keeps: least id (null last), of its texts any one; as sets of candidates."""
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    left, out = set(range(len(rows))), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            left -= near
            todo += near
        least = min((rows[k][0] is None, rows[k][0] or 0) for k in group)
        out.append([rows[k] for k in group if (rows[k][0] is None, rows[k][0] or 0) == least])
    return out


def test_keep_one_by_row(spark):
    df = frame(spark, ROWS)
    assert jaccard_links(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0
    left = keep_one(df)
    assert left.columns == df.columns
    got, count = collections.Counter((r.doc_id, r.text) for r in left.collect()), collections.Counter(ROWS)
    for group in plain_kept(ROWS):
        assert any(got == count[row] for row, got in got.items() if row in group)
    assert len(got) == len({min(map(repr, g)) for g in plain_kept(ROWS)})


def test_keep_one_keeps_texts_that_are_nowhere_else(spark):
    a = [f"w{k}" for k in range(100)]
    near, far = " ".join(a + ["more"]), " ".join(f"z{k}" for k in range(30))
    rows = [(1, " ".join(a)), (2, near), (2, far), (None, near), (None, "only here and without a name"), (3, far + " end")]
    left = collections.Counter((r.doc_id, r.text) for r in keep_one(frame(spark, rows)).collect())
    assert left == collections.Counter([rows[0], rows[2], rows[4]])


def test_jaccard_of_long_texts(spark):
    long = " ".join(f"w{k * k % 9973}x{k % 89}" for k in range(200_000))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_links(frame(spark, [(1, long), (2, long + " more"), (3, "some other text of seven words here")])).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_trie_join_finds_every_component():
    import numpy as np

    r = random.Random(9)
    for _ in range(60):
        sets = []
        for _ in range(r.randint(2, 25)):
            if sets and r.random() < 0.7:
                s = set(r.choice(sets).tolist())
                for _ in range(r.randint(0, 3)):
                    s ^= {r.randrange(60)}
            else:
                s = {r.randrange(60) for _ in range(r.randint(0, 20))}
            sets.append(np.array(sorted(s), np.int64))
        sizes = [len(s) + r.choice([0, 0, 1]) for s in sets]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sizes[a] and sizes[b] and len(np.intersect1d(sets[a], sets[b])) >= needed_overlap(sizes[a], sizes[b])]

        def parts(links):
            up = list(range(len(sets)))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in links:
                up[root(a)] = root(b)
            return {frozenset(k for k in range(len(up)) if root(k) == x) for x in {root(k) for k in range(len(sets))}}

        links = [(a, b) for a, b in trie_join(sets, sizes) if sizes[a] and sizes[b]]
        assert parts(links) == parts(pairs)


# ---- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
    out = P.run(spark, sf)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
    before = P.STAGES[1][1](spark, P.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf)
    comps = plain_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, _, c in comps if c == i}
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_pipeline_stages_on_awkward_rows(spark, sf):
    """Nulls, repeated ids, blanks, clashing columns, an empty table: every stage gives a defined result."""
    import corpus_pipeline as P

    rows = [(i, t) for i, t in ROWS if len(t or "") < 1000] + [(None, "x y z " * 30), (None, "x y z " * 30)]
    for docs in (frame(spark, rows), frame(spark, rows).limit(0)):
        names, before = docs.columns, collections.Counter((r.doc_id, r.text) for r in docs.collect())
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            after = collections.Counter((r.doc_id, r.text) for r in docs.collect())
            assert docs.columns == names
            if name in ("toxicity", "near_duplicates"):
                assert not after - before
            if name == "source_mix":
                assert set(after) == set(before)
            before = after
        out = P.byte_bpe(spark, docs, sf)
        assert out.where("not round_trip").count() == 0 and out.count() == before.total()
    assert P.byte_bpe(spark, frame(spark, rows).select("doc_id", "text"), sf).columns == ["doc_id", "n_tokens", "ids", "round_trip"]
