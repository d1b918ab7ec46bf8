"""How far the sources of a language part in their words, by integer-dictionary encoding.

Method: a task encodes its texts by a dictionary of its own: distinct terms sorted by their bytes, tokens as positions in
it, counted by group with one ``bincount``. These counts are summed by Spark. The terms that a language keeps are ranged by
their UTF-8 bytes and cut into chunks of so many terms that a chunk's counts of all the language's sources are about
``CELLS`` numbers. A chunk's task finds the ids of its terms by ``searchsorted`` in the sorted array, fills the dense matrix
of sources by terms, and works out probabilities and divergences on whole arrays of integers. Ids follow the order of the
bytes, so ties fall to the lower id. Chunks give partial sums for pairs of sources and the best terms of each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship_package

#: Fixed by the contract.
SCALE_STEPS, LEAST_DOCS, TOP_TERMS = 3, 3, 200
#: Numbers in a chunk's dense matrix (8 bytes each).
CELLS = 1 << 18
#: Bytes of text that a task encodes at once.
SLICE = 4 << 20

_COUNTS_SQL = "lang string, source string, term binary, n long, docs long"
_FOUND_SQL = "lang string, source string, part string, item binary, value long"


def _term_bytes() -> np.ndarray:
    """Byte -> byte: A-Z lowered, 0 for what is in no term. Bytes over 0x7F are parts of non-ASCII characters."""
    t = np.zeros(256, np.uint8)
    t[0x61:0x7B] = t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


_TABLE = _term_bytes()


def term_tokens(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts laid end to end, text k from ``starts[k]`` -> (terms in order, as binary, and the text of each)."""
    b = _TABLE[data]
    inside = b != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    here = starts[starts < len(data)]
    first[here] = inside[here]  # a text's first character starts a term whatever came before
    at = np.flatnonzero(first)
    chars = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(chars, at), len(chars)).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(b[chars])])
    return terms, np.searchsorted(starts, at, side="right") - 1


def count_terms(data: np.ndarray, starts: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, group, id, occurrences, texts) of the terms of some texts, each in a group; ids are places in the
    dictionary, which is sorted by bytes."""
    terms, of = term_tokens(data, starts)
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
    size = max(len(order), 1)
    n = np.bincount(group[of] * size + ids, minlength=n_groups * size) if len(ids) else np.zeros(n_groups * size, np.int64)
    seen = np.unique(of * size + ids)
    docs = np.bincount(group[seen // size] * size + seen % size, minlength=n_groups * size)
    live = np.flatnonzero(n)
    return coded.dictionary.take(pa.array(order)), live // size, live % size, n[live], docs[live]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> terms counted by (lang, source), a slice of texts at a time.

    Each (lang, source) that occurs also gives one row with a null term, so that groups without terms are known. Long
    texts are cut where no term is, if they can be; such a text counts once for each of its terms.
    """
    from tidemark.llm.text_hash import slices

    for b in batches:
        text, sizes = b.column(2), pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
        names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for lo, hi in slices(sizes, SLICE, 1 << 20):
            keys = {k: i for i, k in enumerate(dict.fromkeys(names[lo:hi]))}
            listed = list(keys)
            group = np.array([keys[k] for k in names[lo:hi]], np.int64)
            yield _tally_rows(listed, np.arange(len(listed)), pa.nulls(len(listed), pa.binary()), np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64))
            parts = text.slice(lo, hi - lo).cast(pa.large_binary())
            offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
            held = parts.buffers()[2]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
            if hi - lo > 1 or len(data) <= 2 * SLICE:
                words, g, i, n, docs = count_terms(data, offsets[:-1] - offsets[0], group, len(listed))
                yield _tally_rows(listed, g, words.take(pa.array(i)), n, docs)
            else:
                yield from _tally_long(listed, data)


def _tally_long(listed: list[tuple[str, str]], data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One long text, piece by piece: occurrences of each piece, then one row a distinct term for the text."""
    zero, seen, lo = np.zeros(1, np.int64), pa.array([], pa.large_binary()), 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        while hi < len(data):  # on to the next byte that is in no term
            stop = np.flatnonzero(_TABLE[data[hi : hi + 65_536]] == 0)
            hi = hi + int(stop[0]) if len(stop) else min(hi + 65_536, len(data))
            if len(stop):
                break
        words, g, i, n, _ = count_terms(data[lo:hi], zero, zero, 1)
        yield _tally_rows(listed, g, words.take(pa.array(i)), n, np.zeros(len(i), np.int64))
        seen, lo = pa.concat_arrays([seen, words]).unique(), hi
    once = np.zeros(len(seen), np.int64)
    yield _tally_rows(listed, once, seen, once, once + 1)


def _tally_rows(listed: list[tuple[str, str]], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    at = pa.array(group)
    lang, source = (pa.array([k[i] for k in listed], pa.string()).take(at) for i in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, terms.cast(pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exact for totals under 9 * 10**15: three digits at a time."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so squares fit."""
    return (p - q) ** 2 // q


def _chunk(best: int):
    """One chunk of a language's kept terms: rows (source, term, n) and, with a null term, each source's total and the
    language's number of kept terms v."""

    def work(table: pa.Table) -> pa.Table:
        heads, rows = (table.filter(f(table.column("term"))) for f in (pc.is_null, pc.is_valid))
        lang, v = heads.column("lang")[0].as_py(), heads.column("v")[0].as_py()
        names = np.array([s.encode() for s in heads.column("source").to_pylist()], object)
        by = np.argsort(names)
        names, totals = names[by], heads.column("n").to_numpy()[by]
        terms = rows.column("term").combine_chunks().to_numpy(zero_copy_only=False)
        kept = np.unique(terms) if len(terms) else np.zeros(0, object)
        ids = np.searchsorted(kept, terms) if len(terms) else np.zeros(0, np.int64)
        group = np.searchsorted(names, np.array([s.encode() for s in rows.column("source").to_pylist()], object)) if len(terms) else ids
        dense = np.zeros(len(names) * len(kept), np.int64)
        np.add.at(dense, group * len(kept) + ids, rows.column("n").to_numpy())
        dense = dense.reshape(len(names), len(kept))
        p = shares(dense, (totals + v)[:, None]) if len(kept) else dense
        q = shares(dense.sum(0), totals.sum() + v) if len(kept) else np.zeros(0, np.int64)
        who, what, item, value = [], [], [], []
        for g in range(len(names)):
            others = np.flatnonzero(np.arange(len(names)) != g)
            who += [names[g]] * len(others)
            what += ["pair"] * len(others)
            item += names[others].tolist()
            value += [int(divergence(p[g], p[o]).sum()) for o in others]
            some = np.flatnonzero((dense[g] > 0) & (p[g] > q))
            f = divergence(p[g, some], q[some])
            top = np.argsort(-f, kind="stable")[:best]  # equal values: the lower id, that is the lesser bytes
            who += [names[g]] * len(top)
            what += ["term"] * len(top)
            item += kept[some[top]].tolist()
            value += f[top].tolist()
        return pa.table({"lang": pa.array([lang] * len(who), pa.string()), "source": pa.array([w.decode() for w in who], pa.string()), "part": pa.array(what, pa.string()), "item": pa.array(item, pa.binary()), "value": pa.array(value, pa.int64())})

    return work


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, best: int = TOP_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its divergence from every other (part ``pair``)
    and the ``best`` terms that it has more of than the language (part ``term``).

    Null text, language and source are empty strings; each row is a document, repeated ids or not. A source without kept
    terms has the share of no occurrence for each; a language without any has pairs of value 0; a single source has no
    pairs. Counts are whole numbers throughout. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    tallies = docs.select(*text).mapInArrow(_tally, _COUNTS_SQL)
    counts = materialize(tallies.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    groups = counts.where("term is null").select("lang", "source")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    # positions in a range sort by (lang, UTF-8 bytes) cut the dictionary into chunks that follow each other
    placed = materialize(kept.orderBy("lang", "term").withColumn("m", F.monotonically_increasing_id()), "dictionary")
    placed = placed.withColumn("p", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    by_part = placed.groupBy("lang", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"))  # a row a partition and language
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_part.select("lang", "p", (ahead - F.col("low")).alias("ahead"))
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("g")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    of_lang = materialize(of_lang.withColumn("width", F.greatest(F.floor(F.lit(cells) / F.col("g")), F.lit(1))), "languages")
    cuts = before.join(of_lang, "lang").select("lang", "p", "ahead", "width")
    dictionary = placed.join(cuts, ["lang", "p"]).select("lang", "term", F.floor((F.col("i") + F.col("ahead")) / F.col("width")).alias("chunk"))
    rows = materialize(counts.where("term is not null").join(dictionary, ["lang", "term"]).select("lang", "chunk", "source", "term", "n"), "encoded")
    totals = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    chunks = of_lang.select("lang", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("v") / F.col("width")), F.lit(1)) - 1)).alias("chunk"))
    heads = totals.join(chunks, "lang").select("lang", "chunk", "source", F.lit(None).cast("binary").alias("term"), "n", "v")
    found = heads.unionByName(rows, allowMissingColumns=True).groupBy("lang", "chunk").applyInArrow(_chunk(best), _FOUND_SQL)
    merged = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("item", F.col("item").cast("string"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return merged.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")

