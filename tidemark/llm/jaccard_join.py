"""N-gram Jaccard join: exact links between texts at a threshold, and the components they form.

1. Every text's distinct shingles (64-bit hashes) go, packed by task into hash partitions of 6 bytes a shingle, to where
   equal ones meet. What comes back is one number per text: how many of its shingles some other text has. A text of
   which fewer than 80 % are shared cannot link to any other, whatever the others are; this leaves few.
2. Equal sets become one class, so copies cost nothing from here on.
3. Among the classes left, shingles get their document frequency; the global order is by frequency, then hash. The
   prefix rule holds for any global order: two sets that link share a shingle of their prefixes (the first
   n - ceil(0.8 n) + 1). Classes that share one are joined to a star on it, and stars to candidate components.
4. Each candidate component is joined exactly, every pair of different sets included: its ordered sets are the paths of
   a prefix tree whose nodes hold stretches of tokens. All sets walk down the tree together, level by level; sets below a
   node share the overlap found so far, and a subtree is left as soon as that overlap and the least of the two remaining
   lengths cannot reach what its smallest set needs. Components are cut into cells of ``CELL`` classes and every pair of
   cells is joined by itself, so no task grows with the size of a component and no pair is lost. All links are counted,
   by class size; only a spanning forest of them leaves a task.
5. Links give the final components. Rows meet their class's facts by a shuffle, except those of the ``HOT`` largest
   classes, which are broadcast.

Lengths: overlap o of sets of a and b shingles links them if 100 o >= 80 (a + b - o).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_hash import byte_slices, shingle_sets, word_bytes
from tidemark.operators.joins import join_hot
from tidemark.operators.sets import connected_components
from tidemark.session import materialize, ship_package, task_count

K = 5
PERCENT = 80
#: Classes of a cell; a task joins two cells at most.
CELL = 500
#: Pairs of (set, node) whose tokens are looked at in one step of a walk, by tokens.
STEP = 4_000_000
#: Shingles that a task gathers before it hands them over, packed.
FLUSH = 2_000_000

_PACKED = pa.schema([("p", pa.int32()), ("chunk", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_PACKED_SQL = "p int, chunk string, a binary, b binary, c binary, d binary"


def needed_overlap(a, b, percent: int = PERCENT):
    """Least o with 100 o >= percent (a + b - o)."""
    return -((-percent * (a + b)) // (100 + percent))


def set_digests(h: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums over each text's set, the same for equal sets whatever their order."""
    out = np.zeros((n, 2), np.uint64)
    if len(h):
        ids, first = np.unique(t, return_index=True)
        for j, (mul, rot) in enumerate(((0xD6E8FEB86659FD93, 29), (0xA3B195354A39B70D, 31))):
            x = h * np.uint64(mul)
            x = (x ^ (x >> np.uint64(rot))) * np.uint64(mul)
            out[ids, j] = np.add.reduceat(x ^ (x >> np.uint64(32)), first)
    return out.view(np.int64)


def _pack_documents(parts: int, k: int):
    """Texts -> packed rows: for p < parts (fingerprints, document numbers); for p >= parts the documents' own facts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table = TaskContext.get().partitionId(), word_bytes()
        seq, held, count = 0, [], 0
        ids, keys, sizes, digests, reps, seen = [], [], [], [], [], {}

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, count, ids, keys, sizes, digests, reps, seen
            chunk = f"{task}-{seq}"
            rows = [(parts + (task * 131 + seq) % parts, chunk, np.array([x is not None for x in ids], np.uint8).tobytes() + np.array([x or 0 for x in ids] + keys, "<i8").tobytes(), np.concatenate(sizes).astype("<u4").tobytes(), np.concatenate(digests).astype("<i8").tobytes(), np.array(reps, "<u2").tobytes())]
            part = np.concatenate([x for x, _, _ in held]) if held else np.zeros(0, np.uint32)
            order = np.argsort(part, kind="stable")
            fp, doc = (np.concatenate([x[i] for x in held])[order] if held else np.zeros(0) for i in (1, 2))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                lo, hi = cuts[p], cuts[p + 1]
                if hi > lo:
                    rows.append((p, chunk, fp[lo:hi].astype("<u4").tobytes(), doc[lo:hi].astype("<u2").tobytes(), None, None))
            seq, held, count = seq + 1, [], 0
            ids, keys, sizes, digests, reps, seen = [], [], [], [], [], {}
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

        for batch in batches:
            names, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, texts in byte_slices(batch.column(1)):
                if len(ids) + hi - lo > 60_000:
                    yield flush()
                h, t = shingle_sets(texts, k, table)
                n = np.bincount(t, minlength=hi - lo)
                d = set_digests(h, t, hi - lo)
                base, stand = len(ids), np.zeros(hi - lo, bool)
                for i in range(hi - lo):  # copies inside a chunk are sent once
                    key = (int(n[i]), int(d[i, 0]), int(d[i, 1]))
                    if key not in seen:
                        seen[key] = base + i
                        stand[i] = True
                    reps.append(seen[key])
                ids += names[lo:hi]
                keys += marks[lo:hi]
                sizes.append(n)
                digests.append(d)
                own = stand[t]
                h, t = h[own], t[own] + base
                held.append(((h % np.uint64(parts)).astype(np.uint32), (h // np.uint64(parts)).astype(np.uint32), t.astype(np.uint16)))
                count += len(h)
                if count > FLUSH:
                    yield flush()
        if ids:
            yield flush()

    return pack


def _count_shared(parts: int):
    """Per partition of fingerprints: for each chunk, how many of each document's shingles occur twice or more."""

    def count(table: pa.Table) -> pa.Table:
        p, chunks = table.column("p")[0].as_py(), table.column("chunk").to_pylist()
        if p >= parts:
            return table
        fps = [np.frombuffer(x, "<u4") for x in table.column("a").to_pylist()]
        docs = [np.frombuffer(x, "<u2") for x in table.column("b").to_pylist()]
        fp = np.concatenate(fps)
        order = np.argsort(fp)
        s = fp[order]
        same = np.concatenate(([False], s[1:] == s[:-1], [False]))
        shared = np.zeros(len(fp), bool)
        shared[order] = same[1:] | same[:-1]
        rows, lo = [], 0
        for chunk, doc in zip(chunks, docs):
            hit = doc[shared[lo : lo + len(doc)]]
            lo += len(doc)
            if len(hit):
                who, many = np.unique(hit, return_counts=True)
                rows.append((-1, chunk, who.astype("<u2").tobytes(), many.astype("<u4").tobytes(), None, None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, _PACKED)], schema=_PACKED)

    return count


def _unpack_documents(percent: int):
    """Per chunk: document rows with their share of shared shingles decided."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("near", pa.bool_())])

    def unpack(table: pa.Table) -> pa.Table:
        own = next(r for r in table.to_pylist() if r["p"] >= 0)
        n = np.frombuffer(own["b"], "<u4").astype(np.int64)
        there = np.frombuffer(own["a"][: len(n)], np.uint8)
        ids, keys = np.frombuffer(own["a"][len(n) :], "<i8").reshape(2, -1)
        d = np.frombuffer(own["c"], "<i8").reshape(-1, 2)
        rep = np.frombuffer(own["d"], "<u2")
        shared = np.zeros(len(n), np.int64)
        for p, a, b in zip(table.column("p").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()):
            if p < 0:
                shared[np.frombuffer(a, "<u2")] += np.frombuffer(b, "<u4").astype(np.int64)
        shared = shared[rep]
        near = (n > 0) & (100 * shared >= percent * n)
        return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=there == 0), pa.array(keys), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(near)], schema=out)

    return unpack


def document_sets(df: DataFrame, id_col: str, text_col: str, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n, d1, d2, near) per row: key is a hash of its text; size and digest of its set; near: enough shingles are shared to link at all."""
    ship_package(df.sparkSession)
    parts = task_count(df.sparkSession, df)
    packed = df.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(_pack_documents(parts, k), _PACKED_SQL)
    counted = packed.groupBy("p").applyInArrow(_count_shared(parts), _PACKED_SQL)
    return materialize(counted.groupBy("chunk").applyInArrow(_unpack_documents(percent), "doc_id long, key long, n long, d1 long, d2 long, near boolean"), "sets")


def _class_shingles(parts: int, k: int):
    """(node, n, d1, d2, text) -> packed (hashes, nodes, sizes) by partition of the hash; texts of another set are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, count = word_bytes(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            h, node, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            part = h % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            h, node, n, cuts = h[order], node[order], n[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            rows = [(p, None, h[a:b].tobytes(), node[a:b].tobytes(), n[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            held, count = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

        for batch in batches:
            node, n, d1, d2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for lo, hi, texts in byte_slices(batch.column(4)):
                h, t = shingle_sets(texts, k, table)
                d = set_digests(h, t, hi - lo)
                right = (np.bincount(t, minlength=hi - lo) == n[lo:hi]) & (d[:, 0] == d1[lo:hi]) & (d[:, 1] == d2[lo:hi])
                keep = right[t]
                h, t = h[keep], t[keep]
                held.append((h, node[lo:hi][t].astype(np.int64), n[lo:hi][t].astype(np.int32)))
                count += len(h)
                if count > FLUSH // 3:
                    yield flush()
        if count:
            yield flush()

    return pack


def _frequencies(parts: int):
    """Per partition of hashes: those of two nodes or more, packed anew by node."""

    def count(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("c").to_pylist()])
        order = np.lexsort((node, h))
        h, node, n = h[order], node[order], n[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))  # repeated rows
        h, node, n = h[new], node[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        freq = np.repeat(np.diff(np.append(first, len(h))), np.diff(np.append(first, len(h)))).astype(np.int32)
        keep = freq > 1
        h, node, n, freq = h[keep], node[keep], n[keep], freq[keep]
        q = (node % parts).astype(np.int32)
        order = np.argsort(q, kind="stable")
        h, node, n, freq, cuts = h[order], node[order], n[order], freq[order], np.searchsorted(q[order], np.arange(parts + 1))
        rows = [(p, None, h[a:b].tobytes(), node[a:b].tobytes(), n[a:b].tobytes(), freq[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, _PACKED)], schema=_PACKED)

    return count


_SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("freq", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SETS_SQL = "node long, n int, tokens binary, freq binary, prefix array<long>"


def _order_sets(percent: int):
    """Per bucket of nodes: each node's shared shingles in the global order, and those of them in its prefix."""

    def order_all(table: pa.Table) -> pa.Table:
        h, node, n, freq = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int32), ("d", np.int32)))
        order = np.lexsort((h, freq, node))
        h, node, n, freq = h[order], node[order], n[order], freq[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))), len(node))
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            size = int(n[a])
            least = -(-percent * size // 100)
            length = size - least + 1 - (size - (b - a))  # shingles of frequency one come first and join nothing
            if length > 0:
                rows.append((int(node[a]), size, h[a:b].tobytes(), freq[a:b].tobytes(), h[a : a + length].view(np.int64).tolist()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, _SETS)], schema=_SETS)

    return order_all


class PrefixTree:
    """Sorted token arrays in dictionary order as the paths of a tree; a node holds a stretch of tokens without a fork.

    Arrays by node, parents before children: ``up`` (parent), ``low`` (its first leaf), ``least`` (size of the smallest set
    below), ``rest`` (most tokens of a path below), ``first`` and ``length`` (its tokens in ``tokens``). ``kids`` and
    ``ends`` list a node's children and the leaves whose paths end there, as (start, count, items). Node 0 is the root.
    """

    def __init__(self, paths: list[np.ndarray], size: np.ndarray):
        m = len(paths)
        depth, low, end, up, stack, at = [0], [0], [m], [-1], [0], np.zeros(m, np.int64)

        def node(d: int, lo: int) -> int:
            depth.append(d), low.append(lo), end.append(m), up.append(0)
            return len(depth) - 1

        for i, path in enumerate(paths):
            common = 0
            if i:
                last = paths[i - 1]
                k = min(len(last), len(path))
                off = np.flatnonzero(last[:k] != path[:k])
                common = int(off[0]) if len(off) else k
            while depth[stack[-1]] > common:
                done = stack.pop()
                end[done] = i
                if depth[stack[-1]] < common:  # the paths part inside the stretch: a node for what they share
                    stack.append(node(common, low[done]))
                up[done] = stack[-1]
            if len(path) > common:
                stack.append(node(len(path), i))
            at[i] = stack[-1]
        for child, parent in zip(stack[1:], stack):
            up[child] = parent
        order = np.lexsort((depth, low))  # parents first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        depth, low, end = (np.array(x, np.int64)[order] for x in (depth, low, end))
        up, at = np.where(order == 0, 0, place[np.array(up)[order]]), place[at]
        self.low, self.up = low, up
        below = np.array([len(p) for p in paths], np.int64)
        self.least = np.array([size[a:b].min() for a, b in zip(low, end)], np.int64)
        self.rest = np.array([below[a:b].max() for a, b in zip(low, end)], np.int64) - depth
        self.length = depth - depth[up]
        self.first = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate([paths[a][d - n : d] for a, d, n in zip(low, depth, self.length)])
        self.kids = self._lists(up[1:], np.arange(1, len(up)), len(up))
        self.ends = self._lists(at, np.arange(m), len(up))

    @staticmethod
    def _lists(of: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.bincount(of, minlength=n)
        return np.cumsum(count) - count, count, items[np.argsort(of, kind="stable")]


def _spread(lists: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``nodes``, item) for every item of the lists of ``nodes``."""
    start, count, items = lists
    n = count[nodes]
    pick = np.repeat(start[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(nodes)), n), items[pick]


def trie_links(sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT, sides: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """All links among ``sets``, sorted arrays of token numbers in the global order, as (one set, others); no pair comes twice.

    ``sizes`` counts all tokens, those that no other set has included; with ``sides``, pairs of one side are left out. Each
    set walks down the tree of those before it in dictionary order.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    paths, back = [sets[i] for i in order], np.array(order, np.int64)
    m, size = len(paths), np.array([sizes[i] for i in order], np.int64)
    wide = 1 + max((int(p[-1]) for p in paths if len(p)), default=-1)
    if m < 2 or not wide:
        return
    tree, side = PrefixTree(paths, size), None if sides is None else np.asarray(sides)[order]
    many = np.array([len(p) for p in paths], np.int64)
    block = int(np.clip(16_000_000 // wide, 1, 256))
    for lo in range(1, m, block):
        hi = min(m, lo + block)
        has = np.zeros((hi - lo, wide), bool)
        for q in range(lo, hi):
            has[q - lo, paths[q]] = True
        keys = np.concatenate([paths[q] + (q - lo) * wide for q in range(lo, hi)])
        start = np.cumsum(many[lo:hi]) - many[lo:hi]
        q = np.repeat(np.arange(lo, hi), tree.kids[1][0])
        node = np.tile(tree.kids[2][: tree.kids[1][0]], hi - lo)
        overlap, found = np.zeros(len(q), np.int64), []
        while True:
            keep = tree.low[node] < q
            q, node, overlap = q[keep], node[keep], overlap[keep]
            if not len(q):
                break
            n = tree.length[node]
            cuts = np.append(np.flatnonzero(np.diff(np.cumsum(n) // STEP, prepend=-1)), len(q))
            for a, b in zip(cuts, cuts[1:]):
                token = tree.tokens[np.repeat(tree.first[node[a:b]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(int(n[a:b].sum()))]
                overlap[a:b] += np.add.reduceat(has[np.repeat(q[a:b] - lo, n[a:b]), token], np.cumsum(n[a:b]) - n[a:b], dtype=np.int64)
            passed = np.searchsorted(keys, (q - lo) * wide + tree.tokens[tree.first[node] + n - 1], "right") - start[q - lo]
            reach = overlap + np.minimum(many[q] - passed, tree.rest[node])
            keep = reach >= np.maximum(needed_overlap(size[q], tree.least[node], percent), 1)
            q, node, overlap = q[keep], node[keep], overlap[keep]
            at, leaf = _spread(tree.ends, node)
            hit = (leaf < q[at]) & (overlap[at] >= np.maximum(needed_overlap(size[q[at]], size[leaf], percent), 1))
            if side is not None:
                hit &= side[leaf] != side[q[at]]
            found.append((q[at][hit], leaf[hit]))
            at, node = _spread(tree.kids, node)
            q, overlap = q[at], overlap[at]
        if found:
            one, other = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(one, kind="stable")
            one, other = one[by], other[by]
            edges = np.append(np.flatnonzero(np.diff(one, prepend=-1)), len(one))
            for a, b in zip(edges, edges[1:]):
                yield order[one[a]], back[other[a:b]]


def trie_join(sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The pairs of ``trie_links``."""
    return [(s, r) for s, rs in trie_links(sets, sizes, percent, sides) for r in rs.tolist()]


_JOIN_SQL = "u long, v long, links long"


def _join_cells(percent: int):
    """Rows of one bucket: several whole components, or two cells of a large one. Every link is found; what goes out is
    who is joined by them, each node with the least of its tree (u, v), and for each class the documents of the classes
    it links to (u, links)."""

    def join(table: pa.Table) -> pa.Table:
        comp, node, n, docs, mine = (table.column(c).to_numpy() for c in ("comp", "node", "n", "docs", "mine"))
        apart = table.column("apart").to_numpy(zero_copy_only=False)
        tokens, freq = table.column("tokens").to_pylist(), table.column("freq").to_pylist()
        us, vs, links = [], [], np.zeros(len(node), np.int64)
        order = np.argsort(comp, kind="stable")
        cuts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(comp[order]) != 0))), len(order))
        for a, b in zip(cuts, cuts[1:]):
            pick = order[a:b]
            hs = [np.frombuffer(tokens[i], np.uint64) for i in pick]
            fs = np.concatenate([np.frombuffer(freq[i], np.int32) for i in pick])
            every, where, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
            rank = np.empty(len(every), np.int64)
            rank[np.lexsort((every, fs[where]))] = np.arange(len(every))
            numbers = np.split(rank[back], np.cumsum([len(h) for h in hs])[:-1])
            label = np.arange(len(pick))
            for x, ys in trie_links(numbers, n[pick].tolist(), percent, mine[pick] if apart[pick[0]] else None):
                links[pick[x]] += docs[pick[ys]].sum()
                links[pick[ys]] += docs[pick[x]]
                for tree in np.unique(label[ys]).tolist():
                    if tree != label[x]:
                        label[label == tree] = label[x]
            least = np.full(len(pick), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node[pick])
            below = node[pick] != least[label]
            us += node[pick][below].tolist()
            vs += least[label][below].tolist()
        some = np.flatnonzero(links)
        gone = pa.nulls(len(us), pa.int64()), pa.nulls(len(some), pa.int64())
        return pa.table({
            "u": pa.concat_arrays([pa.array(us, pa.int64()), pa.array(node[some], pa.int64())]),
            "v": pa.concat_arrays([pa.array(vs, pa.int64()), gone[1]]),
            "links": pa.concat_arrays([gone[0], pa.array(links[some])]),
        })

    return join


def link_classes(classes: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int = K, percent: int = PERCENT, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the classes that link to others, and (node, links): the documents of all classes a class links to.

    ``classes`` has node, n, d1, d2, docs (its number of documents), rep and key: id and text key of a row that has the set.
    """
    spark = df.sparkSession
    parts = task_count(spark, df)
    # one plan at every size: texts and the classes' representatives meet by a shuffle, hashed on the side of the latter
    texts = df.select(F.col(id_col).cast("long").alias("t_id"), F.xxhash64(text_col).alias("t_key"), F.col(text_col).alias("t"))
    texts = texts.join(classes.hint("shuffle_hash"), F.col("t_id").eqNullSafe(F.col("rep")) & (F.col("t_key") == F.col("key"))).select("node", "n", "d1", "d2", "t")
    packed = texts.mapInArrow(_class_shingles(parts, k), _PACKED_SQL)
    by_node = packed.groupBy("p").applyInArrow(_frequencies(parts), _PACKED_SQL)
    sets = materialize(by_node.groupBy("p").applyInArrow(_order_sets(percent), _SETS_SQL), "ordered")
    prefix = materialize(sets.select("node", F.explode("prefix").alias("token")), "prefix")
    centre = prefix.groupBy("token").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("nodes"))
    stars = join_hot(prefix, centre, ["token"], "nodes").select(F.col("node").alias("u"), "v")
    comps = materialize(connected_components(stars), "candidates")
    sized = comps.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    cells = F.ceil(F.col("members") / F.lit(cell)).cast("int")
    placed = join_hot(comps, sized, ["root"], "members").join(classes.select("node", "docs"), "node").select("node", F.col("root").alias("comp"), "docs", cells.alias("cells"))
    mine = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    # a large component's node goes to every pair of cells that holds its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    # a cell's own pairs are taken where it meets itself, so no link counts twice
    spread = placed.select("node", "comp", "docs", "cells", mine.alias("mine"), F.explode(pairs).alias("ij")).withColumn("apart", F.col("ij.i") != F.col("ij.j"))
    bucket = F.when(F.col("cells") == 1, F.pmod(F.xxhash64("comp"), F.lit(4 * parts))).otherwise(F.xxhash64("comp", "ij"))
    joined = spread.withColumn("bucket", bucket).join(sets.drop("prefix"), "node").select("bucket", "comp", "node", "docs", "mine", "apart", "n", "tokens", "freq")
    found = materialize(joined.groupBy("bucket").applyInArrow(_join_cells(percent), _JOIN_SQL), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    return connected_components(found.where("v is not null").select("u", "v")), counts


def _decided(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, cell: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, n_links, kept) per input row; key is a hash of its text.

    Of a component one document is kept: that of the smallest id (null last), then of the smallest text key.
    """
    docs = document_sets(df, id_col, text_col, k, percent)
    spot = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    classes = docs.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(spot).alias("first"), F.max("near").alias("near"), F.count(F.lit(1)).alias("docs"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = classes.where("near").select("node", "n", "d1", "d2", "docs", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"))
    found, counts = link_classes(near, df, id_col, text_col, k, percent, cell)
    found = materialize(found, "components")
    members = found.join(classes.select("node", "first"), "node")
    keepers = members.groupBy("root").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("members"))
    moved = join_hot(members, keepers, ["root"], "members").select("node", "keeper").join(counts, "node")
    facts = classes.join(moved, "node", "left").select("n", "d1", "d2", "docs", F.coalesce("keeper", "first").alias("keeper"), F.coalesce("links", F.lit(0)).alias("links"))
    worded = join_hot(docs.where("n > 0").drop("near"), materialize(facts, "facts"), ["n", "d1", "d2"], "docs")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key"))
    worded = worded.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("keeper.doc_id").alias("component_id"), (F.col("docs") - 1 + F.col("links")).cast("long").alias("n_links"), is_keeper.alias("kept"))
    blank = docs.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return worded.unionByName(blank)


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per input row: the smallest id reachable by links, its own included, and
    the number of other rows whose texts link to its own, copies among them.

    Ids are whole numbers. Null and empty texts, and texts without words, have no shingles and are their own component.
    Rows that repeat an id are rows of one document: each row has the component its own text gives it. A null id is never
    the smallest; it is null where the component has no other, and its text links others like any text. Other columns
    are ignored; an empty table gives no rows.
    """
    return _decided(df, id_col, text_col, k, percent, cell).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns as they were.

    It is the one with the smallest id (null last) and, of several texts under that id, the smallest text key. Rows that
    repeat both id and text are one document and stay or go together; a row whose id occurs elsewhere with another text
    is decided by its own text. Texts without words stay. An empty table gives no rows.
    """
    gone = materialize(_decided(docs, id_col, text_col, K, PERCENT, CELL).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "dropped")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_col) == F.col("gone_key"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
