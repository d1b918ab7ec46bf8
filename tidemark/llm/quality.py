"""Quality rules: a table of thresholds compiled into one projection of text statistics. No user functions.

The statistics a rule may name are built-in expressions over the words and lines of the text; ``compile_rules`` turns
the table into one boolean per rule and a verdict. Repeated three-word windows: as many distinct 64-bit hashes as windows
means that none repeats (the usual case, one pass); otherwise a sort by hash and words brings equal windows together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, WORD_CLASS, words_of

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"

#: Common function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the be to of and that have with in is it for on are as was this by at an or from a "
    "der die das und ist nicht von mit den dem ein eine zu im des auf als auch sich er "
    "le la les et est un une que qui pour dans par sur avec du de en au "
    "el los las y del se con por para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``stat`` must lie in [low, high]; a missing bound is open."""

    name: str
    stat: str
    low: float | None = None
    high: float | None = None


#: Thresholds in common use, but for the share of duplicate lines, which was raised from 0.3 to 0.7 by ``labels.quality``
#: of the sample tables: license lines repeat in good documents there.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("shouting", "marks_per_word", None, 0.1),
    Rule("stop_words", "stop_words", 2, None),
    Rule("stop_ratio", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.7),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis", "ellipsis_line_ratio", None, 0.3),
    Rule("repetition", "repeat_word_ratio", None, 0.5),
)


def _repeat_words(ordered: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, from (hash, words, position) in order."""
    same = lambda x, y: x["h"].eqNullSafe(y["h"]) & x["g"].eqNullSafe(y["g"])
    twice = F.filter(ordered, lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every statistic a rule can name. Null text has no words, lines or characters."""
    t = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    a = t.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("all_lines"))
    lines = F.filter("all_lines", lambda x: x.rlike(WORD_CLASS))
    three = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    h = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), three)
    chars = lambda which: F.regexp_count("t", F.lit(which)).cast("long")
    b = a.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - chars(SPACE_CLASS)).alias("word_chars"),
        chars(f"[{SYMBOLS}]").alias("n_symbols"),
        chars("!").alias("n_marks"),
        lines.alias("l"),
        h.alias("h"),
        "w",
        F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS)).alias("stops"),
    )
    c = b.select(
        "*",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i"))))).alias("o"),
    )
    n_lines = F.size("l")
    per = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    d = c.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_marks",
        F.size(F.array_distinct(F.transform("stops", lambda x: F.lower(x)))).cast("long").alias("stop_words"),
        F.size("stops").cast("long").alias("n_stop"),
        (n_lines - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("o").isNull(), F.lit(0)).otherwise(_repeat_words(F.col("o"))).cast("long").alias("n_repeat_words"),
        F.size(F.filter("l", lambda x: x.rlike(r"^\s*(?:[-*•‣]|\d+[.)])\s"))).alias("n_bullets"),
        F.size(F.filter("l", lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).alias("n_ellipsis"),
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "stop_words",
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        per(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        per(F.col("n_marks"), F.col("n_words")).alias("marks_per_word"),
        per(F.col("n_stop"), F.col("n_words")).alias("stop_ratio"),
        per(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        per(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        per(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        per(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean expression per rule: true where the rule holds."""
    out = {}
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.stat) >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (F.col(r.stat) <= F.lit(r.high))
        out[r.name] = ok
    return out


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the statistics, ``failed`` (names of rules that do not hold) and ``passed``.

    Null and empty texts have all counts 0 and fail the rules that ask for a least value. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """
    checks = compile_rules(rules)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return text_stats(df, id_col, text_col).withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)
