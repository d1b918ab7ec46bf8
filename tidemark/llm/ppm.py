"""Language-model scores: prediction by partial matching over bytes, beside add-half word frequencies.

PPM: training texts fill contexts of bytes of order 5 (``ORDER``) and all shorter ones (a text begins with start marks, so
its first bytes have contexts too, and ends with an end symbol, so the probabilities of all texts add up to one). A symbol
not seen in a context escapes to the next shorter one; the escape's share is estimated by the number of different symbols
seen there (distinct / (count + distinct)), and symbols that a longer context has already offered are excluded from
shorter ones; what no order has seen shares the last escape evenly. A text's score is the sum of log10 probabilities, its
code length with the sign turned. The model is pretrained, so all texts are scored alike and in parallel. Texts are
stored in chunks; each chunk sends its distinct grams (a symbol with its context), packed by hash of the two symbols
before, to where all chunks' counts are added; what comes back is a probability for each gram. The tables grow with the
corpus and no task holds them all; only the counts of symbols by the one before, 257 x 257 of them, are broadcast.

Words: each chunk numbers its distinct words and sends, packed by hash partition, their 64-bit hashes and training
counts; partitions add up the counts of all chunks and answer every chunk in its own order; chunks then score their
documents from the answers. Frequent words cost one entry a chunk, so no word is hot, and every distinct word of the
corpus is counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_hash import byte_slices, slices, word_bytes, word_hashes
from tidemark.session import materialize, ship_package, task_count

#: Symbols before a byte that op10 conditions on; a gram of order 5 fills 54 bits.
ORDER = 5
#: Bytes of text in a chunk; worked on a slice at a time.
CHUNK_BYTES = 12_000_000
SLICE_BYTES = 2_000_000
#: Partitions of grams for one of words.
GRAM_PARTS = 4
#: Symbol 256 starts a text where it is a context and ends it where it is coded.
MARK = 256
SYMBOLS = 257
BITS = 9

_PACKED = pa.schema([("kind", pa.string()), ("p", pa.int32()), ("chunk", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("n", pa.int64()), ("m", pa.int64())])
_PACKED_SQL = "kind string, p int, chunk string, a binary, b binary, c binary, n long, m long"


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_PACKED), _PACKED)]


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes, deflated: small numbers take little room."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every symbol of every text, its end included, with the ``order`` symbols before it; symbols of each text).

    The symbol just before is the key's most significant, the coded one its least: the grams of one context of any order
    are a range of the sorted keys.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    b = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16)
    b[np.cumsum(sizes) - 1] = MARK
    at = np.arange(len(b), dtype=np.int32)
    at -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    keys = np.zeros(len(b), np.int64)
    for j in range(order, 0, -1):
        before = np.full(len(b), MARK, np.int16)
        before[j:] = np.where(at[j:] >= j, b[:-j], np.int16(MARK))
        more = before.astype(np.int64)
        more <<= BITS * (1 + order - j)
        keys |= more
    keys |= b
    return keys, sizes


def _gram_part(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    """Grams meet where the two symbols before say, so all their contexts of order 2 or more are in one place."""
    pair = (keys >> (BITS * (order - 1))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((pair >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, deflated."""
    return zlib.compress(np.ascontiguousarray(np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsteps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def gram_logs(keys: np.ndarray, counts: np.ndarray, order: int, c1: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol after its context: ``keys`` sorted and distinct, ``counts`` from training.

    All grams of a pair of symbols are among ``keys``; c1 has the counts of symbols by the one before. What a longer
    context has seen a shorter one has seen too, so the symbols excluded at an order are those seen at the next longer one.
    """
    symbol, c0 = keys & (1 << BITS) - 1, c1.sum(0)
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    seen, longer = np.zeros(len(keys), np.int64), None  # distinct symbols of the longer context, by gram; its (context, symbol) seen
    for k in range(order, -1, -1):
        if k >= 2:
            ctx = keys >> BITS * (1 + order - k)
            flat = (ctx << BITS) | symbol
            names, back = np.unique(flat, return_inverse=True)
            count = np.bincount(back, weights=counts, minlength=len(names))
            of = names >> BITS
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            at = np.searchsorted(of[first], ctx)  # each gram's context among the distinct ones
            n, q, c = np.add.reduceat(count, first)[at], np.add.reduceat((count > 0).astype(np.int64), first)[at], count[back]
        else:
            ctx = (keys >> BITS * order) if k else np.zeros(len(keys), np.int64)
            table = c1 if k else c0[None]
            n, q, c = table.sum(1)[ctx], (table > 0).sum(1)[ctx], table[ctx, symbol]
        if longer is not None:  # counts here of what the longer context has seen
            which, syms, where = longer
            if k >= 2:
                up = (which >> BITS << BITS) | syms
                here = count[np.searchsorted(names, up)]
            else:
                here = c1[which >> BITS, syms] if k else c0[syms]
            total = np.append(0.0, np.cumsum(here))
            n = n - (total[where[1]] - total[where[0]])
        fresh = q - seen  # symbols seen here that no longer context offers
        more = q < SYMBOLS
        whole = np.where(n > 0, n + np.where(more, fresh, 0), 1.0)
        hit = open_ & (c > 0)
        out[hit] += np.log10(c[hit] / whole[hit])
        miss = open_ & (c == 0) & (n > 0)
        out[miss] += np.log10(fresh[miss] / whole[miss])
        open_ &= c == 0
        seen = q
        if k >= 2:
            some = count > 0
            which, syms = of[some], names[some] & (1 << BITS) - 1
            longer = which, syms, (np.searchsorted(which, ctx), np.searchsorted(which, ctx, "right"))
        elif k == 1:
            which, syms = np.nonzero(c1)
            longer = which, syms, (np.searchsorted(which, ctx), np.searchsorted(which, ctx, "right"))
    out[open_] -= np.log10(SYMBOLS - seen[open_])
    return out


def _numbered(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes by partition, then hash; the number of each of ``h`` among them; where partitions start)."""
    words, back = np.unique(h, return_inverse=True)
    part = (words % np.uint64(parts)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    place = np.empty(len(words), np.int64)
    place[by_part] = np.arange(len(words))
    return words[by_part], place[back], np.searchsorted(part[by_part], np.arange(parts + 1))


def _gather(parts: int, order: int):
    """(doc_id, train, text) -> packed rows by chunk: its documents, its words to count; and symbols by the one before."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table, pairs = TaskContext.get().partitionId(), word_bytes(), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        seq, ids, trains, kept, hashes, counts, n_bytes = 0, [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, trains, kept, hashes, counts, n_bytes
            chunk, train = f"{task}-{seq}", np.array(trains, bool)
            words, back, cuts = _numbered(np.concatenate(hashes), parts)
            learnt = np.bincount(back, weights=np.concatenate(counts), minlength=len(words)).astype(np.int64)
            rows = [("words", p, chunk, words[a:b].tobytes(), _planes(learnt[a:b]), None, 0, 0) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            who = np.array([i is not None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + train.astype(np.uint8).tobytes()
            lengths = np.fromiter(map(len, kept), np.int64, len(kept))
            rows.append(("docs", -1, chunk, _squeeze(b"".join(kept)), _planes(lengths), who, len(ids), int(train.sum())))
            seq, ids, trains, kept, hashes, counts, n_bytes = seq + 1, [], [], [], [], [], 0
            return pa.RecordBatch.from_arrays(_rows(rows), schema=_PACKED)

        for batch in batches:
            names, train = (batch.column(i).to_pylist() for i in range(2))
            for lo, hi, texts in byte_slices(batch.column(2), SLICE_BYTES):
                h, of = word_hashes(texts, table)
                words, back = np.unique(h, return_inverse=True)
                learnt = np.array(train[lo:hi], bool)
                hashes.append(words)
                counts.append(np.bincount(back, weights=learnt[of], minlength=len(words)))
                grams, sizes = gram_keys([t for t, x in zip(texts, learnt) if x], 1)
                pairs += np.bincount((grams >> BITS) * SYMBOLS + (grams & (1 << BITS) - 1), minlength=SYMBOLS * SYMBOLS)
                ids += names[lo:hi]
                trains += train[lo:hi]
                kept += [bytes(t) for t in texts]
                n_bytes += sum(map(len, texts))
                if n_bytes > CHUNK_BYTES:
                    yield flush()
        if ids:
            yield flush()
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(_rows([("pair", -2, None, None, None, None, int(x), int(pairs[x])) for x in some]), schema=_PACKED)

    return gather


def _documents(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(texts, ids, whether there is an id, whether it is learnt from) of a chunk's row."""
    raw, ends = _unsqueeze(row["a"]), np.append(0, np.cumsum(_unplanes(row["b"]).astype(np.int64))).tolist()
    k = len(ends) - 1
    there, ids, train = np.frombuffer(row["c"][:k], np.uint8), np.frombuffer(row["c"][k : 9 * k], "<i8"), np.frombuffer(row["c"][9 * k :], np.uint8)
    return [raw[a:b] for a, b in zip(ends, ends[1:])], ids, there.astype(bool), train.astype(bool)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    return slices([len(t) for t in texts], SLICE_BYTES)


def _distinct_grams(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams, sorted; how often each occurs in texts that are learnt from), a slice at a time."""
    held, counts = [], []
    for lo, hi in _slices(texts):
        grams, sizes = gram_keys(texts[lo:hi], order)
        grams <<= 1
        grams |= np.repeat(train[lo:hi], sizes)
        grams.sort()
        first = np.flatnonzero(np.concatenate(([True], grams[1:] >> 1 != grams[:-1] >> 1)))
        counts.append(np.add.reduceat(grams & 1, first))
        held.append(grams[first] >> 1)
    every, back = np.unique(np.concatenate(held), return_inverse=True)
    return every, np.bincount(back, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _by_part(grams: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = _gram_part(grams, order, parts)
    by_part = np.argsort(part, kind="stable")
    return by_part, np.searchsorted(part[by_part], np.arange(parts + 1))


def _send_grams(parts: int, order: int):
    """Chunks' documents -> their distinct grams with training counts, packed by partition."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                texts, _, _, train = _documents(row)
                grams, counts = _distinct_grams(texts, train, order)
                by_part, cuts = _by_part(grams, order, parts)
                rows = [("grams", p, row["chunk"], _steps(grams[by_part[a:b]]), _planes(counts[by_part[a:b]]), None, 0, 0) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(_rows(rows), schema=_PACKED)

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Per partition of words: training counts over all chunks, given back to each chunk in its order; and totals."""
    hs = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    cs = [_unplanes(x).astype(np.int64) for x in table.column("b").to_pylist()]
    p = table.column("p")[0].as_py()
    words, back = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(cs), minlength=len(words)).astype(np.int64)
    rows, lo = [("total", p, None, None, None, None, int(total.sum()), int((total > 0).sum()))], 0
    for chunk, h in zip(table.column("chunk").to_pylist(), hs):
        rows.append(("counts", p, chunk, total[back[lo : lo + len(h)]].astype("<i8").tobytes(), None, None, 0, 0))
        lo += len(h)
    return pa.Table.from_arrays(_rows(rows), schema=_PACKED)


def _answer_grams(order: int, model):
    """Per partition of grams: training counts over all chunks make their probabilities, given back to each chunk in its
    order as numbers into the list of those that occur."""

    def answer(table: pa.Table) -> pa.Table:
        ks = [_unsteps(x) for x in table.column("a").to_pylist()]
        keys, back = np.unique(np.concatenate(ks), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([_unplanes(x) for x in table.column("b").to_pylist()]), minlength=len(keys))
        logs, p, rows, lo = gram_logs(keys, total, order, model.value), table.column("p")[0].as_py(), [], 0
        for chunk, k in zip(table.column("chunk").to_pylist(), ks):
            values, codes = np.unique(logs[back[lo : lo + len(k)]], return_inverse=True)
            rows.append(("logs", p, chunk, _planes(codes), values.astype("<f8").tobytes(), None, 0, 0))
            lo += len(k)
        return pa.Table.from_arrays(_rows(rows), schema=_PACKED)

    return answer


_BASE = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_chunk(n_train: int, n_distinct: int, n_ends: int, order: int, parts: int):
    """Per chunk: documents' scores from the counts of the chunk's words and the probabilities of its grams. n_ends: training documents, so ends seen."""
    scale = n_train + 0.5 * (n_distinct + 1)

    def score(table: pa.Table) -> pa.Table:
        rows, lower = table.to_pylist(), word_bytes()
        texts, ids, there, train = _documents(next(r for r in rows if r["kind"] == "docs"))
        answers = [np.frombuffer(r["a"], "<i8") for r in sorted((r for r in rows if r["kind"] == "counts"), key=lambda r: r["p"])]
        c = np.concatenate([np.zeros(0, np.int64), *answers])
        found = [np.frombuffer(r["b"], "<f8")[_unplanes(r["a"])] for r in sorted((r for r in rows if r["kind"] == "logs"), key=lambda r: r["p"])]
        del rows
        word_logs = np.log10((c + 0.5) / scale)
        parted = [(lo, hi, *word_hashes(texts[lo:hi], lower)) for lo, hi in _slices(texts)]
        _, numbers, _ = _numbered(np.concatenate([h for *_, h, _ in parted]), parts)
        grams, _ = _distinct_grams(texts, train, order)
        logs = np.zeros(len(grams))
        logs[_by_part(grams, order, GRAM_PARTS * parts)[0]] = np.concatenate(found)
        k, end = len(texts), np.log10((n_ends + 0.5) / scale)
        n, base, known, total, used = np.ones(k, np.int64), np.full(k, end), np.full(k, int(n_ends > 0)), np.zeros(k), 0
        for lo, hi, h, of in parted:
            number = numbers[used : used + len(h)]
            used += len(h)
            n[lo:hi] += np.bincount(of, minlength=hi - lo)
            base[lo:hi] += np.bincount(of, weights=word_logs[number], minlength=hi - lo)
            known[lo:hi] += np.bincount(of, weights=c[number] > 0, minlength=hi - lo).astype(np.int64)
            keys, sizes = gram_keys(texts[lo:hi], order)
            by_key = np.argsort(keys)
            keys = keys[by_key]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            at = np.empty(len(keys))
            at[by_key] = logs[np.searchsorted(grams, keys[new])][np.cumsum(new) - 1]
            total[lo:hi] = np.add.reduceat(at, np.cumsum(sizes) - sizes)
        return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=~there), pa.array(train), pa.array(n), pa.array(known), pa.array(base), pa.array(total)], schema=_BASE)

    return score


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row; learns from rows where ``train``.

    ``order`` is 2 to 5. Ids are whole numbers. Null text is empty: one end token, and the end symbol alone is scored. Rows
    that repeat id and text get the same result each; null ids are allowed. With nothing to learn from, every symbol has
    probability 1/257. Other columns are ignored; an empty table gives no rows.
    """
    if not 2 <= order <= 5:
        raise ValueError("order is 2 to 5")
    spark = df.sparkSession
    ship_package(spark)
    parts = task_count(spark, df)
    docs = df.select(F.col(id_col).cast("long"), train, F.coalesce(F.col(text_col), F.lit("")))
    packed = materialize(docs.mapInArrow(_gather(parts, order), _PACKED_SQL), "chunks")
    answers = materialize(packed.where("kind = 'words'").groupBy("p").applyInArrow(_answer, _PACKED_SQL), "answers")
    total = answers.where("kind = 'total'").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    chunks = packed.where("kind = 'docs'")
    ends = chunks.agg(F.sum("m")).first()[0] or 0
    n_train, n_distinct = (total.n or 0) + ends, (total.m or 0) + (ends > 0)
    c1 = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in packed.where("kind = 'pair'").groupBy("n").agg(F.sum("m").alias("m")).collect():  # 257 x 257 rows at most
        c1[divmod(r.n, SYMBOLS)] = r.m
    model = spark.sparkContext.broadcast(c1)
    grams = chunks.mapInArrow(_send_grams(GRAM_PARTS * parts, order), _PACKED_SQL)
    logs = grams.groupBy("p").applyInArrow(_answer_grams(order, model), _PACKED_SQL)
    every = chunks.unionByName(answers.where("kind = 'counts'")).unionByName(logs)
    out = every.groupBy("chunk").applyInArrow(_score_chunk(n_train, n_distinct, ends, order, parts), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame) -> DataFrame:
    """The query's columns: rows whose crc32 of the id as text leaves 1 modulo 5 are held out of learning."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    s = score_texts(docs.select("doc_id", "text"), ~held, order=ORDER)
    return s.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
