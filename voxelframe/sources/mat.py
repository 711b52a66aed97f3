"""MAT (level 5) files as a data source: spark.read.format("mat").

A row is a row of one array: (file, path, element, row, text, values). path
names a variable and, inside of structs, its fields; element has the place of
the value in each enclosing struct or cell array, counted down the columns;
values are the numbers of one row of a matrix, further dimensions unrolled down
the columns as well; text is set for character arrays instead. A partition is
one variable: the driver reads names only, and tasks decompress theirs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, located

# Fixed values of the format.
MATRIX, COMPRESSED = 14, 15
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
CELL, STRUCT, OBJECT, CHARACTERS, SPARSE = 1, 2, 3, 4, 5
ENCODINGS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
SCHEMA = "file string, path string, element array<long>, row long, text string, values array<double>"
BATCH_VALUES = 1 << 20
_ARROW = pa.schema([("file", pa.string()), ("path", pa.string()), ("element", pa.list_(pa.int64())), ("row", pa.int64()), ("text", pa.string()), ("values", pa.list_(pa.float64()))])


class Elements:
    """Walks tagged elements in a buffer."""

    def __init__(self, raw: bytes, order: str, at: int = 0):
        self.raw, self.order, self.at = memoryview(raw), order, at

    def more(self) -> bool:
        return self.at + 8 <= len(self.raw)

    def next(self) -> tuple[int, memoryview]:
        (kind,) = struct.unpack_from(f"{self.order}I", self.raw, self.at)
        if kind >> 16:  # up to four bytes in the tag itself
            size, kind, start = kind >> 16, kind & 0xFFFF, self.at + 4
            self.at += 8
        else:
            (size,) = struct.unpack_from(f"{self.order}I", self.raw, self.at + 4)
            start = self.at + 8
            self.at = start + size + (-size % 8 if kind != COMPRESSED else 0)
        return kind, self.raw[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, body = self.next()
        return np.frombuffer(body, np.dtype(NUMBERS[kind]).newbyteorder(self.order))


def _headed(parts: Elements) -> tuple[int, bool, tuple[int, ...], str]:
    """(class, whether complex, shape, name) of a matrix element."""
    flags = parts.numbers()
    shape = tuple(int(d) for d in parts.numbers())
    return int(flags[0]) & 255, bool(int(flags[0]) >> 8 & 8), shape, bytes(parts.next()[1]).decode("latin-1")


def leaves(raw: bytes | memoryview, order: str, path: str | None = None, element: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], str | None, np.ndarray | None]]:
    """(path, element, text, (rows, values)) of each array of numbers or characters in a matrix element."""
    if not len(raw):  # an empty place of a cell or struct
        return
    parts = Elements(raw, order)
    kind, complex_, shape, name = _headed(parts)
    path = name if path is None else path
    count = int(np.prod(shape, dtype=np.int64))
    if kind == CELL:
        for k in range(count):
            yield from leaves(parts.next()[1], order, path, (*element, k))
    elif kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            parts.next()
        width = int(parts.numbers()[0])
        names = bytes(parts.next()[1])
        fields = [names[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)]
        for k in range(count):
            for field in fields:
                yield from leaves(parts.next()[1], order, f"{path}.{field}", (*element, k))
    elif kind == CHARACTERS:
        code, body = parts.next()
        text = bytes(body).decode(ENCODINGS[code] + ("" if code == 16 else "-le" if order == "<" else "-be")) if code in ENCODINGS else "".join(map(chr, np.frombuffer(body, np.dtype(NUMBERS[code]).newbyteorder(order))))
        rows = shape[0] if shape else 1
        for k in range(rows):  # characters lie down the columns
            yield path, (*element, k) if rows > 1 else element, text[k::rows], None
    elif kind == SPARSE:
        rows, starts, values = parts.numbers(), parts.numbers(), parts.numbers()
        full = np.zeros(shape)
        full[rows[: len(values)], np.repeat(np.arange(shape[1]), np.diff(starts))] = values
        yield path, element, None, full
    else:
        values = parts.numbers().astype(float)
        if complex_:
            raise ValueError(f"{path} is complex")
        yield path, element, None, values.reshape(shape, order="F").reshape(shape[0], -1, order="F")


@dataclass
class Variable(InputPartition):
    """A top-level element of a file."""

    path: str
    at: int
    size: int
    order: str
    compressed: bool


def _variables(path: str, wanted: set[str] | None) -> Iterator[Variable]:
    fs, name = located(path)
    with fs.open_input_file(name) as file:
        head = file.read_at(128, 0)
        order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
        if order is None:
            raise ValueError(f"{path} is no level 5 MAT file")
        at, end = 128, file.size()
        while at + 8 <= end:
            kind, size = struct.unpack(f"{order}II", file.read_at(8, at))
            if kind in (MATRIX, COMPRESSED):
                start = file.read_at(min(size, 4096), at + 8)
                if kind == COMPRESSED:
                    start = zlib.decompressobj().decompress(start, 4096)[8:]
                if wanted is None or _headed(Elements(start, order))[3] in wanted:
                    yield Variable(path, at + 8, size, order, kind == COMPRESSED)
            at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


class MatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Variable]:
        names = self.options.get("variables")
        wanted = {n.strip() for n in names.split(",")} if names else None
        return [v for path in listed(self.options["path"], (".mat",)) for v in _variables(path, wanted)] or [Variable("", 0, 0, "<", False)]

    def read(self, partition: Variable) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = located(partition.path)
        with fs.open_input_file(name) as file:
            raw = file.read_at(partition.size, partition.at)
        if partition.compressed:
            raw = Elements(zlib.decompress(raw), partition.order).next()[1]
        held, n = [], 0
        for path, element, text, values in leaves(raw, partition.order):
            for row, numbers in enumerate([None] if values is None else values):
                held.append({"file": partition.path, "path": path, "element": list(element), "row": row, "text": text, "values": numbers})
                n += 1 if numbers is None else len(numbers)
                if n >= BATCH_VALUES or len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class Mat(DataSource):
    """Options: path (a file or a folder), variables (names, comma-joined; default: all)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatReader:
        return MatReader({k.lower(): v for k, v in self.options.items()})


def mat_file(spark: SparkSession, path: str, *variables: str) -> DataFrame:
    """The arrays of some variables, or of all."""
    spark.dataSource.register(Mat)
    read = spark.read.format("mat").option("path", path)
    return (read.option("variables", ",".join(variables)) if variables else read).load()


def unrolled(arrays: DataFrame) -> DataFrame:
    """(file, path, element, ix, value) of each number of the arrays, down the columns; 0-based."""
    n = F.max("row").over(_whole()) + 1
    rows = arrays.where("values is not null").withColumn("rows", n)
    return rows.select("file", "path", "element", "row", "rows", F.posexplode("values").alias("column", "value")).select("file", "path", "element", (F.col("column") * F.col("rows") + F.col("row")).alias("ix"), "value")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("file", "path", "element")


def trial_order(arrays: DataFrame, variable: str = "masterordering") -> DataFrame:
    """(trial_ix, image_ix) from a vector of 1-based image numbers, one for each trial."""
    return unrolled(arrays.where(F.col("path") == variable)).select(F.col("ix").alias("trial_ix"), (F.col("value").cast("long") - 1).alias("image_ix"))
