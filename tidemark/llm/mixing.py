"""Mixing sources to target weights.

Method: token shares are raised to an exponent a and normalised (a = 1 keeps the shares, a = 0 makes sources equal).
The exponent is found by bisection on a grid of 2**-20 steps, 64 midpoints a round, so four small aggregates over the
table of sources settle it however many sources there are. The weights are realised by block permutations: each source
is cut into hash blocks of about ``block_tokens`` tokens, blocks are put in a seeded order, whole blocks are taken until
the source's token quota is met, and only the one block at the edge is looked at document by document. A quota above
the source's size first gives every document whole copies. Running sums over a source's blocks are taken in two levels,
over at most ``SPANS`` ranges of the order and inside each range, so no task holds all blocks of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words_of
from tidemark.session import materialize

STEPS = 1 << 20
FAN = 64
#: Ranges of the seeded order that running sums are taken over first.
SPANS = 4096


def _unit_hash(*parts: Column) -> Column:
    """Eight hex digits of MD5 as a number in 0..2**32-1; null parts count as the word null."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 8), 16, 10).cast("long")


def source_sizes(tokens: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of a (doc_id, source, n_tokens) table; sources without tokens have share 0."""
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = sizes.agg(F.sum("tokens").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("source", "tokens", "docs", (F.col("tokens") / F.col("total")).alias("share"))


def solve_exponent(sizes: DataFrame, max_epochs: float | None = None, target_entropy: float | None = None) -> float:
    """Smallest exponent on the grid that meets the repetition limit, or largest whose entropy reaches the target.

    Repetition limit: the largest source is read once, so source s is read (share_max / share_s) ** (1 - a) times, and
    the smallest source's number must not exceed ``max_epochs``. Entropy: -sum w ln w falls as a grows from 0.
    """
    if (max_epochs is None) == (target_entropy is None):
        raise ValueError("give max_epochs or target_entropy, not both")
    live = sizes.where("share > 0").select("share")

    def holds(points: list[int]) -> list[bool]:
        grid = F.explode(F.array(*[F.lit(k) for k in points])).alias("k")
        a = F.col("k") / F.lit(float(STEPS))
        t = live.select("share", grid).withColumn("x", F.pow(F.col("share"), a))
        g = t.groupBy("k").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("zl"), F.max("share").alias("hi"), F.min("share").alias("lo"))
        if max_epochs is not None:
            ok = F.pow(F.col("hi") / F.col("lo"), 1 - a) <= F.lit(float(max_epochs))
        else:
            ok = F.log("z") - F.col("zl") / F.col("z") < F.lit(float(target_entropy))
        return [r.ok for r in g.select("k", ok.alias("ok")).orderBy("k").collect()]  # one row a midpoint: 64

    # invariant: the predicate is false at lo (or lo is below the grid) and true at hi (or hi is beyond it)
    lo, hi = -1, STEPS + (target_entropy is not None)
    while hi - lo > 1:
        points = sorted({lo + max(1, (hi - lo) * i // FAN) for i in range(1, FAN)} - {lo, hi})
        found = holds(points)
        if not found:
            break
        at = next((i for i, x in enumerate(found) if x), len(points))
        lo, hi = (points[at - 1] if at else lo), (points[at] if at < len(points) else hi)
    return (hi if target_entropy is None else max(lo, 0)) / STEPS


def quotas(sizes: DataFrame, exponent: float, budget_tokens: int | None = None) -> DataFrame:
    """(source, tokens, weight, copies, rest): whole copies of each document and tokens of a further part copy.

    Without a budget the largest source is read exactly once and all others at least once.
    """
    x = F.pow(F.col("share"), F.lit(exponent))
    live = sizes.withColumn("x", F.when(F.col("share") > 0, x).otherwise(F.lit(0.0)))
    top = live.agg(F.sum("x").alias("z"), F.max("share").alias("hi"), F.max("tokens").alias("most"))
    w = F.col("x") / F.col("z")
    if budget_tokens is None:
        epochs = F.pow(F.col("hi") / F.col("share"), F.lit(1.0 - exponent))
        quota = F.floor(epochs * F.col("tokens"))
    else:
        quota = F.floor(w * F.lit(float(budget_tokens)))
    quota = F.when(F.col("tokens") > 0, quota).otherwise(F.lit(0)).cast("long")
    return (
        live.crossJoin(F.broadcast(top))
        .select("source", "tokens", w.alias("weight"), quota.alias("quota"))
        .withColumn("copies", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1 if budget_tokens is None else 0)).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("copies") * F.col("tokens"))
    )


def plan_mix(tokens: DataFrame, max_epochs: float | None = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, budget_share: float | None = None, block_tokens: int = 1 << 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Decisions for a (doc_id, source, n_tokens) table: (source, block, copies) and, for edge blocks, (…, doc_id, extra).

    The budget is a number of tokens or a share of the input's; without one every document is read at least once.
    """
    sizes = materialize(source_sizes(tokens), "sources")
    if budget_share is not None:
        if budget_tokens is not None:
            raise ValueError("give budget_tokens or budget_share, not both")
        budget_tokens = int(budget_share * (sizes.agg(F.sum("tokens")).first()[0] or 0))
    exponent = solve_exponent(sizes, max_epochs, target_entropy)
    per = quotas(sizes, exponent, budget_tokens).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long"))
    per = materialize(per, "quotas")
    s = per.select(F.col("source").alias("p_source"), "weight", "copies", "rest", "n_blocks")
    docs = tokens.join(s, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", block_of(F.col("doc_id"), F.col("n_blocks"), seed))
    blocks = docs.groupBy("source", "block", "n_blocks", "weight", "copies", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.withColumn("o", _unit_hash(F.lit(seed), F.col("source"), F.col("block"))).withColumn("span", F.floor(F.col("o") * SPANS / 2.0**32))
    blocks = materialize(blocks, "block-sums")
    spans = blocks.groupBy(F.col("source").alias("s_source"), F.col("span").alias("s_span")).agg(F.sum("block_tokens").alias("span_tokens"))
    by_source = Window.partitionBy("s_source").orderBy("s_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("s_source", "s_span", F.coalesce(F.sum("span_tokens").over(by_source), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "span").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.join(spans, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("span") == F.col("s_span")))
    blocks = blocks.withColumn("ends", F.col("before") + F.sum("block_tokens").over(inside)).withColumn("starts", F.col("ends") - F.col("block_tokens"))
    blocks = materialize(
        blocks.select(
            "source", "block", "n_blocks", "weight", "starts", "rest",
            (F.col("copies") + F.when((F.col("ends") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)).alias("copies"),
            ((F.col("starts") < F.col("rest")) & (F.col("ends") > F.col("rest"))).alias("edge"),
        ),
        "blocks",
    )
    edge = blocks.where("edge").select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), F.col("rest").alias("e_rest"), F.col("starts").alias("e_starts"))
    inner = docs.select("doc_id", "source", "block", "n_tokens").join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    inner = inner.groupBy("source", "block", "e_rest", "e_starts", "doc_id").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source", "block").orderBy(_unit_hash(F.lit(seed), F.lit("doc"), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("upto", F.col("e_starts") + F.sum("n").over(w)).where(F.col("upto") <= F.col("e_rest"))
    return blocks, materialize(inner.select("source", "block", "doc_id"), "edge")


def block_of(doc_id: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(_unit_hash(F.lit(seed), F.lit("block"), doc_id), n_blocks)


def token_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return materialize(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens")), "tokens")


def _with_copies(rows: DataFrame, blocks: DataFrame, edge: DataFrame, seed: int) -> DataFrame:
    """Adds weight, block and copies to rows that have doc_id and source."""
    one = blocks.groupBy("source").agg(F.first("n_blocks").alias("n_blocks")).select(F.col("source").alias("n_source"), "n_blocks")
    b = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "weight", "copies")
    e = edge.select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), F.col("doc_id").alias("e_doc"), F.lit(1).alias("extra"))
    return (
        rows.join(one, F.col("source").eqNullSafe(F.col("n_source")))
        .withColumn("block", block_of(F.col("doc_id"), F.col("n_blocks"), seed))
        .join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
        .join(e, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")) & F.col("doc_id").eqNullSafe(F.col("e_doc")), "left")
        .withColumn("copies", F.col("copies") + F.coalesce(F.col("extra"), F.lit(0)))
    )


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **limits) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, weight of its source, block, copies (0 where a budget leaves it out).

    Tokens are words. Null text has none. A null source is a source of its own; a null id is hashed as the word null.
    Rows that repeat an id share its decision. Documents without words follow their block. Other columns are ignored;
    empty input gives no rows. See :func:`plan_mix` for the limits.
    """
    tokens = token_table(df, id_col, text_col, source_col)
    blocks, edge = plan_mix(tokens, seed=seed, **limits)
    return _with_copies(tokens, blocks, edge, seed).select("doc_id", "source", "n_tokens", "weight", "block", F.col("copies").cast("long").alias("copies"))


def replicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **limits) -> DataFrame:
    """The input's rows, all columns as they were, each as often as :func:`mix_sources` says."""
    blocks, edge = plan_mix(token_table(df, id_col, text_col, source_col), seed=seed, **limits)
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    out = _with_copies(rows, blocks, edge, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
