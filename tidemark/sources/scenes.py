"""Inputs and outputs of a clip that are made of several files or depend on what is there: bundles, views, registries, exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import windows as W
from tidemark.operators.experiments import first_best
from tidemark.operators.sets import dilate
from tidemark.sources.arrays import npz
from tidemark.sources.documents import json_values
from tidemark.sources.sinks import is_complete, write_json

Names = Sequence[str]


def scene_bundle(spark: SparkSession, arrays: str, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arrays, groups, side document) of a scene: arrays (array, index, value) without a numbered prefix; arrays named
    ``<kind><n>_<field>`` as (kind, n, field, index, value); the JSON file beside them as (path, doc)."""
    a = npz(spark, arrays).select("array", "index", "value")
    pattern = r"^([A-Za-z]+)(\d+)_(.+)$"
    g = a.where(F.col("array").rlike(pattern)).select(F.regexp_extract("array", pattern, 1).alias("kind"), F.regexp_extract("array", pattern, 2).cast("int").alias("n"), F.regexp_extract("array", pattern, 3).alias("field"), "index", "value")
    return a.where(~F.col("array").rlike(pattern)), g, json_values(spark, side)


def organ_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arrays (array, index, value), facts (kind, fit)) of an organ's archive; ``fit`` is the embedded document as a variant,
    null where the text is no JSON."""
    a = npz(spark, path)
    text = lambda n: F.max(F.when(F.col("array") == n, F.col("text")))
    facts = a.where(F.col("array").isin("kind", "fit")).agg(text("kind").alias("kind"), text("fit").alias("fit"))
    return a.where(F.col("text").isNull()).select("array", "index", "value"), facts.select("kind", F.try_parse_json("fit").alias("fit"))


def object_masks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(k, obj, u, v) of the set pixels of a mask archive (packed ``masks`` with ``shape`` and ``names``), obj by name; with a
    range of frames only their bytes are read."""
    px = npz(spark, path, packed="true").where(F.col("array") == "masks")
    if first is not None:
        px = px.where(F.col("k") >= first)
    if last is not None:
        px = px.where(F.col("k") <= last)
    names = npz(spark, path).where(F.col("array") == "names").select(F.col("k").alias("__obj"), F.col("text").alias("obj"))  # a row an object
    px = px.select("k", F.col("index")[1].alias("__obj"), F.col("index")[3].alias("u"), F.col("index")[2].alias("v"))
    return px.join(F.broadcast(names), "__obj").select("k", "obj", "u", "v")


def without_instruments(px: DataFrame, roles: DataFrame, soft: Names = ("organ", "strand"), radius: int = 1) -> DataFrame:
    """Masks (k, obj, u, v) whose soft objects lose the pixels within ``radius`` of any instrument's: instruments are always
    in front. ``roles``: (obj, role), a row an object."""
    tagged = px.join(F.broadcast(roles), "obj", "left")
    cover = dilate(tagged.where(F.col("role") == "instrument"), ["k"], radius)
    is_soft = F.coalesce(F.col("role").isin(*soft), F.lit(False))
    rest = tagged.where(is_soft).join(cover, ["k", "u", "v"], "left_anti")
    return rest.select("k", "obj", "u", "v").unionByName(tagged.where(~is_soft).select("k", "obj", "u", "v"))


def model_versions(asked: DataFrame, pinned: dict[str, str], listing: DataFrame, pattern: str = r"/([^/]+)/([^/]+)/model\.npz$") -> DataFrame:
    """(tissue, version): the version asked for, else the pinned one, else the newest folder with a model; ``latest`` names the
    newest too, ``none`` switches a tissue off (null), a path stands for itself. ``asked``: (tissue, version) with nulls."""
    newest = listing.select(F.regexp_extract("path", pattern, 1).alias("tissue"), F.regexp_extract("path", pattern, 2).alias("v")).where("tissue <> ''").groupBy("tissue").agg(F.max("v").alias("__newest"))
    pin = asked.sparkSession.createDataFrame(list(pinned.items()), "tissue string, __pinned string")
    rows = asked.join(F.broadcast(pin), "tissue", "left").join(newest, "tissue", "left")
    chosen = F.coalesce(F.nullif(F.col("version"), F.lit("")), F.col("__pinned"), F.lit("latest"))
    return rows.select("tissue", F.when(chosen == "none", None).when(chosen == "latest", F.col("__newest")).otherwise(chosen).alias("version"))


def first_key_masks(arrays: DataFrame, key_sets: Sequence[Names], fallback: DataFrame | None = None) -> DataFrame:
    """(k, u, v) of a tissue's masks: the arrays of the first key set that is wholly there, or-ed; else ``masks``; else the array
    that is first by name; where there is none, the clip's own mask ``fallback`` (k, u, v).

    ``arrays``: (array, k, u, v), set pixels, with the names of empty arrays as rows without pixels."""
    names = {r.array for r in arrays.select("array").distinct().collect()}  # arrays of one archive
    if not names:
        if fallback is None:
            raise ValueError("there is no mask")
        return fallback.select("k", "u", "v")
    keys = next((list(s) for s in key_sets if set(s) <= names), ["masks"] if "masks" in names else [min(names)])
    return arrays.where(F.col("array").isin(*keys) & F.col("u").isNotNull()).select("k", "u", "v").distinct()


def tool_tracks(old: DataFrame, model: DataFrame | None) -> DataFrame:
    """Tracks (tool, k, tcp, tip, rcm, jaw, heading, source): the interaction model's where it has the tool, else the old
    fit's, whose tip is its tool-centre point. A tool that holds tissue is closed throughout under the model. ``old``: (tool, k,
    tip, rcm, jaw, holds); ``model``: (tool, k, tcp, tip, rcm, heading)."""
    fit = old.select("tool", "k", F.col("tip").alias("tcp"), "tip", "rcm", "jaw", F.lit(None).cast("double").alias("heading"), F.lit("old fit").alias("source"))
    if model is None:
        return fit
    tools = model.select("tool").distinct()
    own = model.join(old.select("tool", "k", F.col("jaw"), "holds"), ["tool", "k"])
    own = own.select("tool", "k", "tcp", "tip", "rcm", F.when(F.col("holds").isNotNull(), 0.0).otherwise(F.col("jaw")).alias("jaw"), "heading", F.lit("model").alias("source"))
    return own.unionByName(fit.join(tools, "tool", "left_anti"))


class Views:
    """All tables of a clip under one name: each made when first asked for, then kept in Spark's cache and as a temporary view.

    ``make`` gives a table by name. ``replaced`` names tables that take the place of others (own masks, other occluders).
    """

    def __init__(self, clip: str, make: dict[str, Callable[[], DataFrame]], replaced: dict[str, Callable[["Views"], DataFrame]] | None = None):
        self.clip, self._make, self._replaced, self._made = clip, dict(make), dict(replaced or {}), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            df = self._replaced[name](self) if name in self._replaced else self._make[name]()
            df = df.cache()
            df.createOrReplaceTempView(f"{self.clip}_{name}".replace("+", "_").replace("-", "_"))
            self._made[name] = df
        return self._made[name]

    def original(self, name: str) -> DataFrame:
        """The table that a replacement stands for."""
        return self._make[name]()

    def with_tables(self, **replaced: Callable[["Views"], DataFrame]) -> "Views":
        """The same clip with some tables replaced; a replacement may read the others and the original."""
        return Views(self.clip, self._make, {**self._replaced, **replaced})

    def close(self) -> None:
        for df in self._made.values():
            df.unpersist()
        self._made.clear()


def solutions(found: dict[str, DataFrame | None], order: Names) -> DataFrame:
    """Camera or depth solutions that are there, in a fixed order of preference: their rows with ``solution`` and ``ord``.
    Missing ones (None, or not in ``found``) are left out; none at all is an error."""
    out = None
    for i, name in enumerate(order):
        df = found.get(name)
        if df is not None:
            part = df.withColumn("solution", F.lit(name)).withColumn("ord", F.lit(i))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the solutions is there")
    return out


def preferred(rows: DataFrame, by: Names) -> DataFrame:
    """Of ``solutions``, each key's row of the first that has it."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("b")).select(*by, "b.*")


def applicable_conditions(asked: DataFrame, objects: DataFrame, default: DataFrame, free: Names = ("measured", "primitive")) -> DataFrame:
    """Conditions (clip, condition, ord) that can be run: those asked for, else the clip's own; those not in ``free`` need an
    organ with a template. objects: (clip, role, template)."""
    own = asked.select("clip").distinct()
    rows = asked.unionByName(default.join(own, "clip", "left_anti"))
    has = objects.where((F.col("role") == "organ") & F.col("template").isNotNull()).select("clip").distinct().withColumn("__t", F.lit(True))
    return rows.join(has, "clip", "left").where(F.col("condition").isin(*free) | F.coalesce("__t", F.lit(False))).drop("__t")


class Registry:
    """Functions by name, as tissue modules and condition builders are looked up; an unknown name is an error that lists them."""

    def __init__(self, contract: Names = ()):
        self._by_name, self.contract = {}, tuple(contract)

    def add(self, name: str, f: Callable) -> Callable:
        self._by_name[name] = f
        return f

    def __call__(self, name: str, *args, **kw):
        if name not in self._by_name:
            raise KeyError(f"{name!r} is none of {sorted(self._by_name)}")
        out = self._by_name[name](*args, **kw)
        missing = [c for c in self.contract if c not in out.columns]
        if missing:
            raise ValueError(f"{name} does not give {missing}")
        return out


def edited(base: DataFrame, edits: DataFrame, key: str = "run") -> DataFrame:
    """Parameters of every run: the base row with what its edit row changes; a null in an edit changes nothing. One row of
    ``base``; an edit may have columns that the base lacks."""
    e = edits.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in edits.columns if c != key])
    both = e.crossJoin(F.broadcast(base.drop(key)))
    cols = [F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in both.columns else F.col(c) for c in base.columns if c != key]
    return both.select(key, *cols, *[F.col(f"__{c}").alias(c) for c in edits.columns if c != key and c not in base.columns])


def build_missing(spark: SparkSession, steps: Sequence[tuple[str, Names, Callable[..., DataFrame]]], folder: str) -> dict[str, DataFrame]:
    """Runs preparation steps (name, needs, function) in order; a step whose table is in the folder is read and not run again."""
    out: dict[str, DataFrame] = {}
    for name, needs, make in steps:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if not is_complete(spark, path):
            make(*[out[n] for n in needs]).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def export_bundle(tables: dict[str, DataFrame], folder: str, index: DataFrame | None = None) -> None:
    """Writes a clip's export: a folder of JSON lines for every table, and the index of clips last, so that what it names is there."""
    for name, df in tables.items():
        write_json(df, f"{folder.rstrip('/')}/{name}")
    if index is not None:
        write_json(index, f"{folder.rstrip('/')}/index")


def replay_table(states: DataFrame, by: Names, k: str, columns: Names, low: float, high: float) -> DataFrame:
    """Positions of every frame as 16-bit steps in one Base64 text a column: by, column, data, n."""
    from tidemark.sources.sinks import base64_series, quantized

    out = None
    for c in columns:
        q = quantized(states.select(*by, k, F.col(c).alias("q")), ["q"], low, high)
        part = base64_series(q, by, [k], "q").join(states.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), list(by)).withColumn("column", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out.select(*by, "column", "data", "n")


def recovered_tools(tracks: DataFrame, holding: DataFrame, ports: DataFrame, order: Names = ("way",)) -> DataFrame:
    """Tools of a clip from their tracks (tool, k, tu, tv, z, visible): where a tool holds (tool, k, hu, hv, hz) its end goes over to
    the holding point within five frames of its last sight, and of several fits of its port (tool, way, cost, x, y, z) the
    cheapest counts, of equals the first: (tool, k, u, v, z, px, py, pz)."""
    last = tracks.where("visible").groupBy("tool").agg(F.max("k").alias("__g"))
    t = tracks.join(last, "tool", "left").join(holding, ["tool", "k"], "left")
    w = F.when(F.col("hu").isNull() | F.col("__g").isNull(), 0.0).otherwise(F.least(F.greatest((F.col("k") - F.col("__g") + 5) / 5.0, F.lit(0.0)), F.lit(1.0)))
    mix = lambda a, b: F.col(a) + w * (F.coalesce(b, a) - F.col(a))
    best = first_best(ports, ["tool"], F.col("cost"), list(order), ["x", "y", "z"]).select("tool", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return t.select("tool", "k", mix("tu", "hu").alias("u"), mix("tv", "hv").alias("v"), mix("z", "hz").alias("z")).join(best, "tool")


def canvas_margin(poses: DataFrame, width: int, height: int, cx: float, cy: float, every: int = 3, extra: int = 48, low: int = 96, high: int = 480) -> DataFrame:
    """Pixels that a canvas around frame 0 must reach beyond it for the corners of every ``every``-th frame (k, rot, f) at depth 1,
    and ``extra`` more, limited: one row (margin). Cameras turn about a fixed point here."""
    zero = poses.where("k = 0").select(F.col("rot").alias("__r0"), F.col("f").alias("__f0"))
    none = F.lit(None).cast("struct<x:double,y:double,z:double>")
    corner = F.explode(F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u in (0, width) for v in (0, height)])).alias("c")
    c = W.every_nth(poses, "k", every).select("rot", "f", corner).crossJoin(F.broadcast(zero))
    w = G.unproject(F.col("c.u"), F.col("c.v"), F.lit(1.0), F.col("rot"), F.col("f"), none, F.lit(cx), F.lit(cy))
    q = c.select(G.project(w, F.col("__r0"), F.col("__f0"), none, F.lit(cx), F.lit(cy)).alias("q")).select("q.*")
    over = q.agg(F.greatest(F.lit(0.0), -F.min("u"), F.max("u") - width, -F.min("v"), F.max("v") - height).alias("o"))
    return over.select(F.floor(F.least(F.greatest(F.col("o") + extra, F.lit(float(low))), F.lit(float(high)))).cast("int").alias("margin"))


__all__ = ["Registry", "Views", "applicable_conditions", "build_missing", "canvas_margin", "edited", "export_bundle", "preferred", "recovered_tools", "replay_table", "scene_bundle", "solutions"]
