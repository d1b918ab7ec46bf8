"""A data source for NumPy archives: arrays of ``.npz`` files as long tables, read by slices; and written, all or nothing.

Reading: the driver lists archives, finds each array's place in its zip file and cuts stored arrays into ranges of their first
axis, one a task. A task seeks to its range and reads nothing else. Filters on ``array`` and ``k`` (the first index: a frame) are
taken into the plan, so frames outside a range are never read. Compressed arrays cannot be sought: one is a task of its own and is
streamed through. Files are opened by ``pyarrow.fs``, so any store that it knows will do.

Writing: tasks write archives of their own names; when all are done the driver puts one manifest in place that names them. A
folder with a manifest is read by it alone, so what a failed task or a failed job left is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Bytes of an array that one task reads, and values that one batch holds.
SLICE_BYTES, BATCH = 16 << 20, 1 << 16
#: File that names the archives of a written folder, and the array beside each written one that has its first indices.
MANIFEST, FIRST_INDEX = "_MANIFEST.json", ".k"

_SCHEMA = "path string, array string, k int, index array<int>, value double, text string"
_ARROW = pa.schema([("path", pa.string()), ("array", pa.string()), ("k", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.float64()), ("text", pa.string())])
#: Bytes of a zip entry's local header before its names, fixed by the format.
_LOCAL_HEADER = 30


def open_file(path: str):
    """A file that can be sought, from any store; tests count its reads."""
    store, where = _store(path)
    return store.open_input_file(where)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_archives(path: str) -> list[str]:
    """Archives of a file, a folder (by its manifest, if it has one) or a name pattern, in order."""
    store, where = _store(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    prefix = path[: len(path) - len(where)] if scheme and path.endswith(where) else scheme
    pattern = None
    if "*" in where:
        where, pattern = where.rsplit("/", 1)
        pattern = re.compile(re.escape(pattern).replace(r"\*", "[^/]*") + "$")
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [prefix + where]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if pattern is None and store.get_file_info(f"{where}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_file(f"{where}/{MANIFEST}") as f:
            return [f"{prefix}{where}/{name}" for name in json.loads(f.read())["files"]]
    found = store.get_file_info(fs.FileSelector(where, recursive=pattern is None))
    names = sorted(i.path for i in found if i.path.endswith(".npz") and (pattern is None or pattern.match(i.base_name)))
    return [prefix + n for n in names]


@dataclass(frozen=True)
class Member:
    """An array in an archive: where its bytes start (None: compressed), its shape and type."""

    path: str
    name: str
    start: int | None
    shape: tuple[int, ...]
    dtype: str
    columns: bool

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def members(path: str) -> list[Member]:
    """The arrays of an archive, from its directory and their headers alone."""
    out = []
    with open_file(path) as raw, zipfile.ZipFile(raw) as z:
        for entry in z.infolist():
            if not entry.filename.endswith(".npy"):
                continue
            with z.open(entry) as f:
                shape, columns, dtype = _header(f)
                length = f.tell()
            start = None
            if entry.compress_type == zipfile.ZIP_STORED:
                raw.seek(entry.header_offset)
                names = struct.unpack("<HH", raw.read(_LOCAL_HEADER)[26:30])
                start = entry.header_offset + _LOCAL_HEADER + sum(names) + length
            if dtype.kind in "biufUS":
                out.append(Member(path, entry.filename[:-4], start, shape, dtype.str, columns))
    return out


class _Slice(InputPartition):
    def __init__(self, member: Member, first: int, last: int, width: int | None, named: str | None):
        super().__init__((member.path, member.name, first, last))
        self.member, self.first, self.last, self.width, self.named = member, first, last, width, named


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.array = options["path"], options.get("array")
        self.bits = options.get("packed", "false").lower() == "true"
        self.size = int(options.get("sliceBytes", SLICE_BYTES))
        self.names: set[str] | None = {self.array} if self.array else None
        self.low, self.high = -(1 << 62), 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of arrays and ranges of ``k`` choose what is read; Spark applies every other filter."""
        for f in filters:
            match f:
                case EqualTo(("array",), str(name)):
                    self._only({name})
                case In(("array",), names):
                    self._only(set(names))
                case EqualTo(("k",), int(k)):
                    self.low, self.high = max(self.low, k), min(self.high, k)
                case GreaterThanOrEqual(("k",), int(k)):
                    self.low = max(self.low, k)
                case GreaterThan(("k",), int(k)):
                    self.low = max(self.low, k + 1)
                case LessThanOrEqual(("k",), int(k)):
                    self.high = min(self.high, k)
                case LessThan(("k",), int(k)):
                    self.high = min(self.high, k - 1)
                case _:
                    yield f

    def _only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in list_archives(self.path):
            held = {m.name: m for m in members(path)}
            width = None
            if self.bits and "shape" in held:
                width = int(_load(held["shape"], 0, held["shape"].shape[0])[-1])
            for m in held.values():
                named = f"{m.name}{FIRST_INDEX}" if f"{m.name}{FIRST_INDEX}" in held else None
                if (self.names is not None and m.name not in self.names) or m.name.removesuffix(FIRST_INDEX) in held and m.name.endswith(FIRST_INDEX):
                    continue
                if not m.shape:  # a single value has no first axis
                    if self.low <= 0 <= self.high:
                        out.append(_Slice(m, 0, 1, None, None))
                    continue
                low, high = (0, m.shape[0]) if named else (max(self.low, 0), min(self.high + 1, m.shape[0]))
                step = max(1, self.size // max(m.row_bytes, 1)) if m.start is not None and not m.columns else max(1, high - low)
                out += [_Slice(m, at, min(at + step, high), width if m.dtype == "|u1" else None, named) for at in range(low, high, step)]
        return out or [_Slice(None, 0, 0, None, None)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        if part.member is None:
            return
        m, first = part.member, part.first
        numbers = None
        if part.named:
            numbers = next(x for x in members(m.path) if x.name == part.named)
            numbers = _load(numbers, part.first, part.last).astype(np.int64)
        for lo in range(part.first, part.last, rows := max(1, BATCH // max(1, int(np.prod(m.shape[1:], dtype=np.int64))))):
            hi = min(lo + rows, part.last)
            a = _load(m, lo, hi) if m.start is not None and not m.columns else _whole(m, part, lo, hi)
            if part.width is not None:
                a = np.unpackbits(a, axis=-1)[..., : part.width]
            ks = np.arange(lo, hi) if numbers is None else numbers[lo - first : hi - first]
            yield from self._rows(m, a, ks)

    def _rows(self, m: Member, a: np.ndarray, ks: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = a.ravel()
        if a.dtype.kind in "US":
            keep = np.arange(len(flat))
            text, value = pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in flat.tolist()]), pa.nulls(len(flat), pa.float64())
        else:
            number = flat.astype(np.float64)
            keep = np.flatnonzero(np.isfinite(number) & ((number != 0) | (not self.bits)))
            text, value = pa.nulls(len(keep), pa.string()), pa.array(number[keep])
        shape = a.shape if m.shape else ()
        index = np.stack(np.unravel_index(keep, shape), 1).astype(np.int32) if shape else np.zeros((len(keep), 0), np.int32)
        if shape:
            index[:, 0] = ks[index[:, 0]]
        for at in range(0, len(keep), BATCH):
            some = index[at : at + BATCH]
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))
            k = pa.array(some[:, 0]) if shape else pa.nulls(len(some), pa.int32())
            n = len(some)
            inside = slice(at, at + n)
            ok = (k.to_numpy() >= self.low) & (k.to_numpy() <= self.high) if shape else np.ones(n, bool)
            batch = pa.RecordBatch.from_arrays([pa.array([m.path] * n), pa.array([m.name] * n), k, wide, value[inside], text[inside]], schema=_ARROW)
            yield batch if ok.all() else batch.filter(pa.array(ok))


def _load(m: Member, first: int, last: int) -> np.ndarray:
    """Rows first..last-1 of an array; of a stored one only these bytes are read."""
    if m.start is None or m.columns or not m.shape:
        return _whole(m, None, first, last)
    dtype = np.dtype(m.dtype)
    with open_file(m.path) as f:
        f.seek(m.start + first * m.row_bytes)
        data = f.read((last - first) * m.row_bytes)
    if len(data) < (last - first) * m.row_bytes:
        raise ValueError(f"{m.path} is cut within {m.name}")
    return np.frombuffer(data, dtype).reshape(last - first, *m.shape[1:])


_KEPT: dict[tuple[str, str], np.ndarray] = {}


def _whole(m: Member, part: _Slice | None, first: int, last: int) -> np.ndarray:
    """Rows of an array that must be read from its start; a task keeps the one that it is at."""
    key = (m.path, m.name)
    if key not in _KEPT:
        _KEPT.clear()
        with open_file(m.path) as raw, zipfile.ZipFile(raw) as z, z.open(f"{m.name}.npy") as f:
            _KEPT[key] = np.lib.format.read_array(f, allow_pickle=False)
    a = _KEPT[key]
    return a[first:last] if a.shape else a


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceArrowWriter):
    """Rows (array, k, values) -> archives of one folder; an array's row k is ``values``, equally long for all its k."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.size = options["path"].rstrip("/"), overwrite, int(options.get("fileBytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        held, size, files = {}, 0, []

        def flush() -> None:
            name = f"part-{uuid.uuid4().hex}.npz"
            arrays = {}
            for array, rows in held.items():
                order = sorted(rows, key=lambda r: r[0])
                arrays[array], arrays[array + FIRST_INDEX] = np.array([r[1] for r in order], np.float64), np.array([r[0] for r in order], np.int64)
            with store.open_output_stream(f"{base}/{name}") as out:
                np.savez(out, **arrays)
            files.append(name)
            held.clear()

        for b in batches:
            for array, k, values in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("array", "k", "values"))):
                held.setdefault(array, []).append((k, [np.nan if v is None else v for v in values]))
                size += 8 * len(values) + 64
                if size >= self.size:
                    flush()
                    size = 0
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        if not self.overwrite and store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_file(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())["files"] + files
        fresh = f"{base}/{MANIFEST}-{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write(json.dumps({"files": files}).encode())
        store.move(fresh, f"{base}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f"{base}/{f}")


class NpzSource(DataSource):
    """``npz(spark, path)``, or ``use_npz(spark)`` and ``read.format("npz").load(path)``: (path, array, k, index, value, text).

    ``index`` is a value's whole place and ``k`` its first part. Non-finite values are absent rows; strings are in ``text``.
    Option ``array`` picks one array, ``packed`` unpacks bit rows and gives set bits. Written are rows (array, k, values).
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(self.options, overwrite)


def use_npz(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    from tidemark.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)


def npz(spark: SparkSession, path: str, **options: str) -> DataFrame:
    use_npz(spark)
    return spark.read.format("npz").options(**options).load(path)


def write_npz(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publishes rows (array, k, values) under ``path``; readers see the old manifest or the new one."""
    use_npz(df.sparkSession)
    df.select(F.col("array").cast("string"), F.col("k").cast("int"), F.col("values").cast("array<double>")).write.format("npz").mode(mode).save(path)
