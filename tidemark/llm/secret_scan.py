"""Secret scans: three fixed rules and sliding-window entropy, as DataFrame expressions only.

Method: candidate strings are maximal runs of letters, digits and + / _ = -, 24 characters or more. Allow-listed stretches
(placeholders, counting sequences, rulers) are cut out of a candidate first, so only windows that touch one are
suppressed, whatever else the candidate holds. Each remaining piece belongs to the narrowest character class that has all
its characters. A window of 24 slides over it one character at a time: the counts of the character that leaves and the one
that comes change by one, and with them the sum of c * log2(c), which is all that Shannon entropy needs. Sums are whole
numbers (millionths), so every engine gets the same. Windows at or over the class's limit are hot; those that overlap or
touch make one span, and cold text between two hot stretches is in none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: the three rules. Runs below the least length cannot match, which is the same as dropping them,
#: except for assign, where a dropped match still uses up its characters.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Character classes, narrowest first: (kind, its characters, least entropy in bits of a hot window). At most log2 of the
#: class's size, or of 24, is possible; random strings of a class lie 0.3 to 0.5 under that.
CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", 3.0),
    ("entropy_letters", "A-Za-z", 4.0),
    ("entropy_alnum", "0-9A-Za-z", 3.9),
    ("entropy_base64", "0-9A-Za-z+/=", 4.0),
    ("entropy_urlsafe", "0-9A-Za-z_=-", 4.0),
    ("entropy_mixed", "0-9A-Za-z+/_=-", 4.1),
)
KINDS = ("assign", "access", "hex", *(kind for kind, _, _ in CLASSES))

WINDOW = 24
#: Known to be no secrets, in either case: placeholders, counting sequences, rulers and pangrams.
ALLOW = r"(?i:example|x{4,}|0{4,}|1234567890|0123456789|abcdefgh|placeholder|your[-_]|changeme|quickbrownfox|-{4,}|={5,}|_{4,})"
SCALE = 1_000_000


def c_log_c(n: int) -> int:
    return round(SCALE * n * math.log2(n)) if n > 1 else 0


def entropy_limit(bits: float) -> int:
    """Entropy of a window is log2(W) - S / W; it reaches ``bits`` when S is at most this."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))


#: Lengths that are added up in one array of running sums.
BLOCK = 256


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _offsets(lengths: Column) -> Column:
    """What the lengths before each one add up to: sums of blocks, then sums inside each, so cost is linear in their number."""
    none = F.array().cast("array<int>")

    def sums(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(xs, first, step, lambda acc: acc["out"])

    def over(all_: Column) -> Column:
        block = lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda t, x: t + x))
        return _with(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(starts, lambda s, b: sums(block(b), s))))

    return F.when(F.size(lengths) > 0, _with(lengths, over)).otherwise(none)


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, value) of each match in code points: lengths of the pieces between matches and of the matches add up."""

    def place(b: Column) -> Column:
        lengths = F.transform(b["found"], lambda v, i: F.length(F.get(b["gaps"], i)) + F.length(v))
        return _with(_offsets(lengths), lambda at: F.transform(b["found"], lambda v, i: _spot(F.get(at, i) + F.length(F.get(b["gaps"], i)), v)))

    return _with(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), place)


def _spot(s: Column, v: Column) -> Column:
    return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"))


def _pieces(value: Column) -> Column:
    """(start, text) of what is left between allow-listed stretches, pieces shorter than a window left out."""

    def place(b: Column) -> Column:
        lengths = F.transform(b["gaps"], lambda v, i: F.length(v) + F.coalesce(F.length(F.get(b["found"], i)), F.lit(0)))
        return _with(_offsets(lengths), lambda at: F.transform(b["gaps"], lambda v, i: F.struct(F.get(at, i).alias("s"), v.alias("v"))))

    cut = _with(F.struct(F.split(value, ALLOW, -1).alias("gaps"), F.regexp_extract_all(value, F.lit(ALLOW), F.lit(0)).alias("found")), place)
    whole = F.array(F.struct(F.lit(0).alias("s"), value.alias("v")))
    return F.filter(F.when(value.rlike(ALLOW), cut).otherwise(whole), lambda x: F.length(x["v"]) >= WINDOW)


def _hot_spans(value: Column, limit: Column) -> Column:
    """(start, end) of the stretches that hot windows cover, by incremental counts over one piece."""
    #: what the sum gains when a count goes from n to n + 1
    gain = F.array(*[F.lit(c_log_c(n + 1) - c_log_c(n)) for n in range(WINDOW + 1)])
    spans = "array<struct<s:int,e:int>>"
    zero = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.array().cast(spans).alias("out"))

    def gained(n: Column) -> Column:
        return F.element_at(gain, n + 1)

    def count(window: Column, ch: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, ch, F.lit("")))

    def slide(acc: Column, ch: Column) -> Column:
        w = acc["w"]
        gone = F.substring(w, 1, 1)
        off = F.when(F.length(w) < WINDOW, F.lit(0)).otherwise(gained(count(w, gone) - 1))
        rest = F.when(F.length(w) < WINDOW, w).otherwise(F.substring(w, 2, WINDOW))
        return F.struct(F.concat(rest, ch).alias("w"), (acc["sum"] - off + gained(count(rest, ch))).cast("long").alias("sum"), (acc["at"] + 1).alias("at"), acc["s"].alias("s"), acc["e"].alias("e"), acc["out"].alias("out"))

    def mark(x: Column) -> Column:
        hot = (x["at"] >= WINDOW) & (x["sum"] <= limit)
        fresh = hot & (x["e"].isNull() | (x["at"] - WINDOW > x["e"]))
        closed = F.when(fresh & x["e"].isNotNull(), F.array_append(x["out"], F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(x["out"])
        return F.struct(x["w"].alias("w"), x["sum"].alias("sum"), x["at"].alias("at"), F.when(fresh, x["at"] - WINDOW).otherwise(x["s"]).alias("s"), F.when(hot, x["at"]).otherwise(x["e"]).alias("e"), closed.alias("out"))

    # folded over one slide, so that what it gives is worked out once
    step = lambda acc, ch: F.aggregate(F.array(slide(acc, ch)), zero, lambda _, x: mark(x))
    last = lambda a: F.when(a["e"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e"))))
    return F.aggregate(F.split(value, ""), zero, step, last)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): an array of (start, order, end, kind) sorted by start, then kind as listed in ``KINDS``.

    Positions are code points, end exclusive. Null text is empty and has no spans. Overlapping spans of different kinds
    all stay. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    t = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rules = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("cand", CANDIDATE))
    hit = t.select("doc_id", "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in rules])
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    placed = hit.select("doc_id", *[F.when(F.size(k) > 0, _placed(F.col("t"), p, F.col(k))).otherwise(none).alias(k) for k, p in rules])

    def span(kind: str):
        return lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["e"].alias("end"), F.lit(kind).alias("kind"))

    def pieces(x: Column) -> Column:
        return F.transform(_pieces(x["v"]), lambda y: F.struct((x["s"] + y["s"]).alias("s"), y["v"].alias("v")))

    def classed(x: Column) -> Column:
        which = F.lit(len(CLASSES) - 1)
        for k in range(len(CLASSES) - 2, -1, -1):
            which = F.when(x["v"].rlike(f"^[{CLASSES[k][1]}]+$"), F.lit(k)).otherwise(which)
        return F.struct(x["s"].alias("s"), x["v"].alias("v"), which.alias("k"))

    limits = F.array(*[F.lit(entropy_limit(bits)) for _, _, bits in CLASSES])
    kinds = F.array(*[F.lit(kind) for kind, _, _ in CLASSES])

    def scored(x: Column) -> Column:
        hot = _hot_spans(x["v"], F.element_at(limits, x["k"] + 1))
        return F.transform(hot, lambda y: F.struct((x["s"] + y["s"]).alias("start"), (x["k"] + KINDS.index(CLASSES[0][0])).alias("order"), (x["s"] + y["e"]).alias("end"), F.element_at(kinds, x["k"] + 1).alias("kind")))

    strong = F.filter("assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 8)
    staged = placed.select("doc_id", strong.alias("assign"), "access", "hex", F.flatten(F.transform("cand", pieces)).alias("cand"))
    staged = staged.select("doc_id", "assign", "access", "hex", F.transform("cand", classed).alias("cand"))
    staged = staged.select("doc_id", "assign", "access", "hex", F.flatten(F.transform("cand", scored)).alias("hot"))
    every = F.concat(F.transform("assign", span("assign")), F.transform("access", span("access")), F.transform("hex", span("hex")), "hot")
    return staged.select("doc_id", F.sort_array(every).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the rules' counts and digest, and all spans as a string."""
    text = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["order"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["order"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
