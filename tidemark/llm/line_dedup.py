"""Repeated runs of lines: later copies are deleted.

Method: documents are sequences of line ids. Suffixes of these sequences are ordered by prefix doubling: the rank of a
suffix by its first 2**(j+1) lines is the rank of the pair (its rank by 2**j lines, the rank of the suffix 2**j lines
on), found by counting and range-sorting the distinct pairs. A line that occurs once ends every repeat, so only lines
that occur at least twice take part, and a pair that occurs once leaves.

A run counts from ``min_words`` words on. Suffixes that share their first m lines form one interval of the suffix array
with a longest common prefix of at least m; two ranks of depth 2**j name it for every m from 2**j to 2**(j+1): that of
the start and that of the last 2**j lines. For each line the shortest run of enough words that starts there, and the
shortest that ends there, is looked up this way; ``run_intervals`` are these intervals, each with its first member. A
maximal repeated run is the union of the shortest runs inside it, so deleting every shortest run that has an earlier
occurrence deletes exactly the later copies of maximal runs, and ``repeated_runs`` joins shortest runs that are copied
from one place to the longest ones. Ranks are needed to the depth of the longest shortest run only: at most
``min_words`` lines, each having a word.

All tables that are shuffled are narrow (ids and ranks); texts are met once, when lines are taken out. Lines, rank pairs
and runs that occur very often are hot keys: the most frequent are broadcast (``join_hot``), and first members are
combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_CLASS
from tidemark.operators.joins import join_hot
from tidemark.session import materialize, ship_package

MIN_WORDS = 50
KEY = ("doc_id", "text_key")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that repeat both id and text are one document; an id with several texts is several documents."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("t"))


def line_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, at, line_no, digest, words): lines that have a word; ``at`` counts only those."""
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("x"))), lambda s: s["x"].rlike(WORD_CLASS))
    rows = _keyed(df, id_col, text_col).select(*KEY, F.posexplode(lines).alias("at", "s"))
    return rows.select(*KEY, "at", F.col("s.line_no").alias("line_no"), F.unhex(F.md5("s.x")).alias("digest"), F.regexp_count("s.x", F.lit(WORD_CLASS + "+")).alias("words"))


def _named(values: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Order-preserving numbers for the distinct values that occur at least twice, and how often they do (n)."""
    twice = values.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(twice.orderBy(*cols).withColumn(name, F.monotonically_increasing_id()), f"names-{name}")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text_key, ls): per document the lines that occur at least twice, as sorted (at, line_no, words, rank)."""
    ids = _named(lines, ["digest"], "line_id")
    hit = join_hot(lines, ids, ["digest"], "n")
    one = F.struct("at", "line_no", "words", F.col("line_id").alias("rank"))
    return hit.groupBy(*KEY).agg(F.sort_array(F.collect_set(one)).alias("ls"))


def double_ranks(ranks: DataFrame, depth: int) -> DataFrame:
    """(doc_id, text_key, at, rank) by 2 * depth lines from the same by ``depth`` lines; unique suffixes are left out."""
    w = Window.partitionBy(*KEY).orderBy("at")
    on = F.first("rank").over(w.rangeBetween(depth, depth))
    pairs = materialize(ranks.select(*KEY, "at", F.col("rank").alias("a"), on.alias("b")).where("b is not null"), f"pairs-{depth}")
    return materialize(join_hot(pairs, _named(pairs, ["a", "b"], "rank"), ["a", "b"], "n").select(*KEY, "at", "rank"), f"ranks-{2 * depth}")


def shortest_runs(at: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, last) positions of the shortest runs of neighbouring lines with enough words: from each start, to each end."""
    total = np.concatenate(([0], np.cumsum(words)))
    island = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))
    n, i = len(at), np.arange(len(at))
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # least last with total[last + 1] - total[i] >= min_words
    ahead = (last < n) & (island[np.minimum(last, n - 1)] == island)
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # largest first with total[i + 1] - total[first] >= min_words
    behind = (first >= 0) & (island[np.maximum(first, 0)] == island)
    return sorted({*zip(i[ahead].tolist(), last[ahead].tolist()), *zip(first[behind].tolist(), i[behind].tolist())})


def _per_document(levels: DataFrame) -> DataFrame:
    """One row per document with parallel arrays, sorted by level, then place."""
    entry = F.struct("level", "at", "rank", "line_no", "words")
    g = levels.groupBy(*KEY).agg(F.sort_array(F.collect_list(entry)).alias("s"))
    return g.select(*KEY, *[F.col(f"s.{c}").alias(c) for c in ("level", "at", "rank", "line_no", "words")])


def _run_lengths(min_words: int):
    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            most = 0
            for at, words in zip(pdf["at"], pdf["words"]):
                most = max([most, *(b - a + 1 for a, b in shortest_runs(np.asarray(at), np.asarray(words), min_words))])
            yield pd.DataFrame({"most": [most]})

    return lengths


def _name_runs(min_words: int):
    """Rows of runs whose both ranks are known, that is, which may occur elsewhere."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, key, level, at, rank, line_no, words in pdf.itertuples(index=False):
                level, at, rank = np.asarray(level), np.asarray(at), np.asarray(rank)
                base = level == 0
                place, lines = at[base], np.asarray(line_no)[base].astype(np.int64)
                ranks = {j: dict(zip(at[level == j].tolist(), rank[level == j].tolist())) for j in np.unique(level).tolist()}
                for a, b in shortest_runs(place, np.asarray(words)[base].astype(np.int64), min_words):
                    m = b - a + 1
                    j = m.bit_length() - 1
                    known = ranks.get(j, {})
                    x, y = known.get(int(place[a])), known.get(int(place[b]) - (1 << j) + 1)
                    if x is not None and y is not None:
                        out.append((doc_id, key, int(place[a]), m, x, y, lines[a : b + 1].tolist()))
            frame = pd.DataFrame(out, columns=["doc_id", "text_key", "at", "m", "head", "tail", "lines"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return name


def named_runs(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, text_key, at, m, head, tail, lines): shortest runs of m lines from ``at`` on, by the interval they lie in."""
    ship_package(df.sparkSession)
    lines = materialize(line_table(df, id_col, text_col), "lines")
    rep = materialize(repeated_lines(lines), "repeated")
    ranks = rep.select(*KEY, F.explode("ls").alias("s")).select(*KEY, F.col("s.at").alias("at"), F.col("s.rank").alias("rank"), F.col("s.line_no").alias("line_no"), F.col("s.words").alias("words"))
    level0 = ranks.withColumn("level", F.lit(0))
    most = rep.select(F.col("ls.at").alias("at"), F.col("ls.words").alias("words")).mapInPandas(_run_lengths(min_words), "most int").agg(F.max("most")).first()[0] or 0
    levels, depth, j, now = level0, 1, 0, ranks.select(*KEY, "at", "rank")
    while 2 * depth <= most:
        now = double_ranks(now, depth)
        depth, j = 2 * depth, j + 1
        levels = levels.unionByName(now.withColumn("level", F.lit(j)), allowMissingColumns=True)
    return materialize(_per_document(levels).mapInPandas(_name_runs(min_words), "doc_id long, text_key long, at int, m int, head long, tail long, lines array<int>"), "runs")


SPOT = ("doc_id", "text_key", "at")


def run_intervals(runs: DataFrame) -> DataFrame:
    """(m, head, tail, n, first): intervals of suffixes with a longest common prefix of at least m lines, two members or
    more, and the first of them."""
    return runs.groupBy("m", "head", "tail").agg(F.min(F.struct(*SPOT)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _later(runs: DataFrame) -> DataFrame:
    """The runs that have an earlier occurrence, with the ``first`` of their interval."""
    return join_hot(runs, run_intervals(runs), ["m", "head", "tail"], "n").where(F.struct(*SPOT) > F.col("first"))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line, n_lines, of_doc): later copies, each the longest that is copied from one place.

    ``of_doc`` is the document of the first occurrence; line numbers count from 0. Edge cases are those of ``clean_lines``.
    """
    later = _later(named_runs(df, id_col, text_col, min_words))
    copy = later.select(*KEY, "at", (F.col("at") + F.col("m")).alias("upto"), F.col("first.doc_id").alias("of_doc"), F.col("first.text_key").alias("of_key"), (F.col("first.at") - F.col("at")).alias("shift"), "lines")
    place = Window.partitionBy(*KEY, "of_doc", "of_key", "shift").orderBy("at")
    reach = F.max("upto").over(place.rowsBetween(Window.unboundedPreceding, -1))
    copy = copy.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(place))
    lines = copy.groupBy(*KEY, "of_doc", "of_key", "shift", "run").agg(F.min(F.element_at("lines", 1)).alias("first_line"), F.max(F.element_at("lines", -1)).alias("last_line"), (F.max("upto") - F.min("at")).alias("n_lines"))
    return lines.select("doc_id", "first_line", "last_line", "n_lines", "of_doc")


def later_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, removed): per document the sorted numbers of lines that are later copies of repeated runs.

    Earlier means smaller id (null first), then text key, then place. Ids must be whole numbers.
    """
    later = _later(named_runs(df, id_col, text_col, min_words))
    # lines of one document's runs overlap; a set per document is bounded by its text
    return later.select(*KEY, F.explode("lines").alias("line")).groupBy(*KEY).agg(F.sort_array(F.collect_set("line")).alias("removed"))


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Each input row as a struct ``row`` with ``clean``, its text without later copies, and ``removed``, their line numbers.

    Null text stays null and has no lines; blank lines stay. Rows that repeat id and text are one document and are
    treated alike. ``clean`` is empty of words where all lines went. Other columns ride along under their own names
    inside ``row``. Empty input gives no rows.
    """
    gone = materialize(later_copies(df, id_col, text_col, min_words), "later").select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "removed")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce(F.col("t"), F.lit(""))))
    # one plan at every size: texts meet the decisions by a shuffle of both, hashed on the side of the decisions
    both = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    both = both.withColumn("ls", F.when(F.col("removed").isNotNull(), F.split("t", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("removed"))  # a hash set, whatever the number of lines
    kept = F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n")
    return both.select("row", F.when(F.col("removed").isNull(), F.col("t")).otherwise(kept).alias("clean"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (numbers, joined by commas), text_sha256 of what is left."""
    c = clean_lines(docs.select("doc_id", "text"))
    worded = F.filter(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"), lambda x: x.rlike(WORD_CLASS))
    return c.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(worded).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.sha2(F.encode(F.coalesce("clean", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` cleaned and ``n_chars``, if there, counted anew; those that lost every line with a word are
    dropped, their text is elsewhere."""
    c = clean_lines(docs)
    left = F.coalesce("clean", F.lit("")).rlike(WORD_CLASS)
    own = {"text": F.col("clean"), "n_chars": F.when(F.size("removed") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    fields = [own[n].alias(n) if n in own else F.col(f"row.`{n}`").alias(n) for n in docs.columns]
    return c.where((F.size("removed") == 0) | left).select(*fields)
