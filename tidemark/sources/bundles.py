"""Exports as one JSON document: small fields, and long series as Base64 blocks, written by many tasks and put in place at once.

A block's bytes come as numbered chunks whose lengths are multiples of three, so their Base64 texts are the block's text end to
end. Each task writes the texts of its chunks to a part file and reports where they lie; when all are done the driver streams the
parts into one document, a piece at a time, and renames it over the old one. A failed task or job leaves the old document.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.functions.scalars import quantize16
from tidemark.session import ship_package
from tidemark.sources.arrays import _store

Names = Sequence[str]

#: Bytes that the driver copies at a time.
PIECE = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    places: list[tuple[str, int, int, int, int]]  # block, chunk, offset, characters, bytes


class BundleWriter(DataSourceArrowWriter):
    """Rows (block, chunk, data) -> one document; option ``fields`` is the JSON text of its other fields."""

    def __init__(self, options: dict):
        self.path, self.fields = options["path"], json.loads(options.get("fields", "{}"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, where = _store(self.path)
        name, out, at, places = None, None, 0, []
        for b in batches:
            for block, chunk, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "chunk", "data"))):
                if out is None:
                    name = f"{where}.part-{uuid.uuid4().hex}"
                    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name)
                text = base64.b64encode(data)
                out.write(text)
                places.append((block, int(chunk), at, len(text), len(data)))
                at += len(text)
        if out is not None:
            out.close()
        return _Part(name, places)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, where = _store(self.path)
        parts = [m for m in messages if m is not None and m.name]
        blocks: dict[str, list] = {}
        for m in parts:
            for block, chunk, at, size, n in m.places:
                blocks.setdefault(block, []).append((chunk, m.name, at, size, n))
        try:
            for block, chunks in blocks.items():
                chunks.sort()
                if [c[0] for c in chunks] != list(range(len(chunks))) or any(c[4] % 3 for c in chunks[:-1]):
                    raise ValueError(f"the chunks of {block} do not follow each other")
            store.create_dir(where.rsplit("/", 1)[0], recursive=True)
            fresh = f"{where}.new-{uuid.uuid4().hex}"
            with store.open_output_stream(fresh) as out:
                out.write(json.dumps({"fields": self.fields}).encode()[:-1] + b', "blocks": {')
                for i, block in enumerate(sorted(blocks)):
                    out.write((", " if i else "").encode() + json.dumps(block).encode() + b': "')
                    for _, name, at, size, _ in blocks[block]:
                        with store.open_input_file(name) as part:
                            part.seek(at)
                            while size:
                                data = part.read(min(size, PIECE))
                                out.write(data)
                                size -= len(data)
                    out.write(b'"')
                out.write(b"}}")
            store.move(fresh, where)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(m.name)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "block string, chunk int, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(self.options)


def write_bundle(blocks: DataFrame, path: str, fields: dict | None = None) -> None:
    """Publishes (block, chunk, data) and ``fields`` as the document ``path``."""
    ship_package(blocks.sparkSession)
    blocks.sparkSession.dataSource.register(BundleSource)
    rows = blocks.select(F.col("block").cast("string"), F.col("chunk").cast("int"), "data")
    rows.write.format("bundle").option("fields", json.dumps(fields or {})).mode("overwrite").save(path)


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fields as a variant, blocks (block, data)) of a document."""
    doc = spark.read.text(path, wholetext=True)
    both = doc.select(F.from_json("value", "blocks map<string,string>").alias("b"), F.try_variant_get(F.try_parse_json("value"), "$.fields", "variant").alias("fields"))
    return both.select("fields"), both.select(F.explode("b.blocks").alias("block", "text")).select("block", F.unbase64("text").alias("data"))


def little_endian(q: Column) -> Column:
    """Two bytes of a 16-bit number, the low one first, as hexadecimal text."""
    bits = q.cast("int").bitwiseAND(F.lit(65535))
    return F.concat(F.lpad(F.hex(bits.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftrightunsigned(bits, 8)), 2, "0"))


def position_blocks(states: DataFrame, block: str, k: str, v: str, low: float, high: float, frames: int = 48) -> DataFrame:
    """(block, chunk, data): the positions of a run (block, k, v, x, y, z), frame by frame and vertex by vertex, as 16-bit steps
    between two bounds; a chunk holds ``frames`` frames, a multiple of three. Frames are numbered from 0 without gaps."""
    if frames % 3:
        raise ValueError("chunks hold a multiple of three frames")
    texts = F.concat(*[little_endian(quantize16(F.col(c), low, high)) for c in "xyz"])
    rows = states.select(F.col(block).cast("string").alias("block"), F.floor(F.col(k) / frames).cast("int").alias("chunk"), F.struct(F.col(k).alias("k"), F.col(v).alias("v"), texts.alias("t")).alias("e"))
    g = rows.groupBy("block", "chunk").agg(F.sort_array(F.collect_list("e")).alias("es"))
    return g.select("block", "chunk", F.unhex(F.array_join(F.col("es.t"), "")).alias("data"))


def export_clip(path: str, name: str, states: DataFrame, facts: DataFrame, bounds: tuple[float, float], by: str = "condition", k: str = "k", v: str = "v", index: tuple[DataFrame, str] | None = None) -> None:
    """A clip's export: the document with each condition's positions as a block and its facts, a row a condition, as fields; the
    bounds say how steps become numbers. ``index`` (a table of clips, where it is published) is put in place after it."""
    from tidemark.sources.sinks import replace_table

    rows = [json.loads(x) for x in facts.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]]  # a row a condition
    write_bundle(position_blocks(states, by, k, v, *bounds), path, {"name": name, "quant": list(bounds), "conditions": rows})
    if index is not None:
        replace_table(*index)
