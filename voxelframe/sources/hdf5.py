"""HDF5 containers as a data source: spark.read.format("hdf5").

A dataset is read as (file, row, values): one row for each place of its first
axis, with the rest unrolled in C order. The driver reads the header of each
file; a partition is a range of rows along whole chunks, and its task descends
the chunk index only where it meets that range, so nothing else is opened.
The layouts are those that common writers produce by default (contiguous,
compact, and chunked with a version 1 B-tree; deflate, shuffle and checksum
filters; numbers of any byte order). Others raise an error.

Written are (row, values) with values of one length: each task gives files of
bounded size with the datasets row and values, chunked and deflated, and the
commit moves the files of successful tasks into the folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import Parts, listed, located

# Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
DATASPACE, DATATYPE, FILL, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 1, 3, 5, 6, 8, 11, 16, 17
COMPACT, CONTIGUOUS, CHUNKED = 0, 1, 2
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NODE_ENTRIES, GROUP_ENTRIES = 64, 8
ENDINGS = (".h5", ".hdf5", ".h5py", ".mat")
#: Values to an Arrow batch, and bytes to a partition and to a written file.
BATCH_VALUES, PARTITION_BYTES, FILE_BYTES = 1 << 20, 64 << 20, 64 << 20


@dataclass
class Chunk:
    """A stored chunk: its place in the file, its size there, the filters that it skips, and its first indexes."""

    address: int
    size: int
    skipped: int
    start: tuple[int, ...]


class Container:
    """An open file."""

    def __init__(self, path: str):
        self.path = path
        fs, name = located(path)
        self.file = fs.open_input_file(name)
        self.opened: list[tuple[int, int]] = []  # (address, size) of every stretch that was read
        self.base = 0
        while self.read(self.base, 8) != SIGNATURE:  # a user block may come before: its size is 0 or a power of two
            self.base = max(512, self.base * 2)
            if self.base >= self.file.size():
                raise ValueError(f"{path} is no HDF5 file")
        version = self.read(self.base + 8, 1)[0]
        if version < 2:
            (sizes,) = struct.unpack("<H", self.read(self.base + 13, 2))
            root = self.base + 24 + (4 if version else 0) + 32
            (header,) = struct.unpack("<Q", self.read(root + 8, 8))
        else:
            (sizes,) = struct.unpack("<H", self.read(self.base + 9, 2))
            (header,) = struct.unpack("<Q", self.read(self.base + 12 + 24, 8))
        if sizes != 0x0808:
            raise ValueError(f"{path}: addresses of other sizes than 8 bytes")
        self.root = header

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def fetch(self, address: int, n: int) -> bytes:
        self.opened.append((address, n))
        return self.read(self.base + address, n)

    def close(self) -> None:
        self.file.close()

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """(kind, body) of an object header's messages, of either version."""
        at = self.base + address
        if self.read(at, 4) == b"OHDR":
            flags = self.read(at + 5, 1)[0]
            at += 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks = [(at + width, int.from_bytes(self.read(at, width), "little"))]
            head = 6 if flags & 4 else 4
            while blocks:
                at, n = blocks.pop(0)
                raw, k = self.read(at, n), 0
                while k + head <= n:
                    kind, size = struct.unpack_from("<BH", raw, k)
                    body = raw[k + head : k + head + size]
                    if kind == CONTINUED:
                        where, length = struct.unpack_from("<QQ", body)
                        blocks.append((self.base + where + 4, length - 8))  # without signature and checksum
                    else:
                        yield kind, body
                    k += head + size
        else:
            _, _, count, _, size = struct.unpack("<BBHII", self.read(at, 12))
            blocks = [(at + 16, size)]
            while blocks and count:
                at, n = blocks.pop(0)
                raw, k = self.read(at, n), 0
                while k + 8 <= n and count:
                    kind, size = struct.unpack_from("<HH", raw, k)
                    body = raw[k + 8 : k + 8 + size]
                    count -= 1
                    if kind == CONTINUED:
                        where, length = struct.unpack_from("<QQ", body)
                        blocks.append((self.base + where, length))
                    else:
                        yield kind, body
                    k += 8 + size

    def members(self, address: int) -> dict[str, int]:
        """Header addresses of a group's members, by name."""
        out = {}
        for kind, body in self.messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", body)
                (names,) = struct.unpack("<Q", self.read(self.base + heap + 24, 8))
                for node in self._symbol_nodes(tree):
                    (n,) = struct.unpack("<H", self.read(self.base + node + 6, 2))
                    raw = self.read(self.base + node + 8, 40 * n)
                    for k in range(n):
                        name, header = struct.unpack_from("<QQ", raw, 40 * k)
                        out[self._text(self.base + names + name)] = header
            elif kind == LINK:
                flags, k = body[1], 2
                hard = True
                if flags & 8:
                    hard, k = body[k] == 0, k + 1
                k += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                name = body[k + width : k + width + n].decode()
                if hard:
                    (out[name],) = struct.unpack_from("<Q", body, k + width + n)
        return out

    def _text(self, at: int) -> str:
        raw = b""
        while b"\0" not in raw:
            more = self.read(at + len(raw), 64)
            if not more:
                break
            raw += more
        return raw.split(b"\0")[0].decode()

    def _symbol_nodes(self, address: int) -> Iterator[int]:
        _, _, level, used = struct.unpack("<4sBBH", self.read(self.base + address, 8))
        raw = self.read(self.base + address + 24, 16 * used + 8)
        for k in range(used):
            (child,) = struct.unpack_from("<Q", raw, 16 * k + 8)
            if level:
                yield from self._symbol_nodes(child)
            else:
                yield child

    def dataset(self, name: str | None = None) -> Dataset:
        """A dataset by its path of group names; by default the first by name in the root group."""
        address = self.root
        for part in [p for p in name.split("/") if p] if name else [None]:
            found = self.members(address)
            part = part or min(found, default="")
            if part not in found:
                raise KeyError(f"{self.path} has no {name or 'dataset'}; there are {sorted(found)}")
            address = found[part]
        return Dataset(self, dict(self.messages(address)))


def _number_type(body: bytes) -> np.dtype:
    kind, flags, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    order = ">" if flags & 1 else "<"
    if kind == 0 and size in (1, 2, 4, 8):
        return np.dtype(f"{order}{'i' if flags & 8 else 'u'}{size}")
    if kind == 1 and size in (2, 4, 8):
        return np.dtype(f"{order}f{size}")
    if kind == 8:  # an enumeration: its base type follows
        return _number_type(body[8:])
    raise ValueError(f"no numbers: datatype class {kind} of {size} bytes")


class Dataset:
    """An array of numbers in a container."""

    def __init__(self, container: Container, messages: dict[int, bytes]):
        if not {DATASPACE, DATATYPE, LAYOUT} <= messages.keys():
            raise ValueError("not a dataset")
        self.container = container
        space = messages[DATASPACE]
        self.shape = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
        self.dtype = _number_type(messages[DATATYPE])
        self.fill = self._fill(messages.get(FILL, b""))
        self.filters = self._pipeline(messages.get(FILTERS, b""))
        self.chunk: tuple[int, ...] | None = None
        layout = messages[LAYOUT]
        version, self.address = layout[0], UNDEFINED
        if version in (1, 2):
            rank, self.kind = layout[1], layout[2]
            at = 8 if self.kind == COMPACT else 16
            if self.kind != COMPACT:
                (self.address,) = struct.unpack_from("<Q", layout, 8)
            sizes = struct.unpack_from(f"<{rank}I", layout, at)
            if self.kind == COMPACT:
                (n,) = struct.unpack_from("<I", layout, at + 4 * rank)
                self.content = layout[at + 4 * rank + 4 : at + 4 * rank + 4 + n]
            elif self.kind == CHUNKED:
                self.chunk = sizes[:-1]
        elif version == 3:
            self.kind = layout[1]
            if self.kind == COMPACT:
                (n,) = struct.unpack_from("<H", layout, 2)
                self.content = layout[4 : 4 + n]
            elif self.kind == CONTIGUOUS:
                (self.address,) = struct.unpack_from("<Q", layout, 2)
            else:
                (self.address,) = struct.unpack_from("<Q", layout, 3)
                self.chunk = struct.unpack_from(f"<{layout[2] - 1}I", layout, 11)
        else:
            raise ValueError(f"layout version {version} is not supported")

    def _fill(self, body: bytes):
        zero = np.zeros(1, self.dtype)[0]
        if len(body) < 2:
            return zero
        if body[0] in (1, 2):
            defined, at = len(body) > 3 and (body[0] == 1 or body[3]), 4
        else:
            defined, at = body[1] & 0x20, 2
        n = struct.unpack_from("<I", body, at)[0] if defined and len(body) >= at + 4 else 0
        return np.frombuffer(body, self.dtype, 1, at + 4)[0] if n == self.dtype.itemsize else zero

    @staticmethod
    def _pipeline(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        out, at = [], 8 if body and body[0] == 1 else 2
        for _ in range(body[1] if body else 0):
            (kind,) = struct.unpack_from("<H", body, at)
            named = body[0] == 1 or kind >= 256
            (name,) = struct.unpack_from("<H", body, at + 2) if named else (0,)
            at += 4 if named else 2
            _, n = struct.unpack_from("<HH", body, at)
            at += 4 + (name + 7 & ~7 if body[0] == 1 else name)
            out.append((kind, struct.unpack_from(f"<{n}I", body, at)))
            at += 4 * (n + (n & 1 if body[0] == 1 else 0))
            if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"filter {kind} is not supported")
        return out

    @property
    def width(self) -> int:
        """Values to a row."""
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @cached_property
    def band(self) -> int:
        """Rows that one chunk covers."""
        return self.chunk[0] if self.chunk else 1

    def chunks(self, first: int, last: int, node: int | None = None) -> Iterator[Chunk]:
        """Stored chunks that meet rows first to last (exclusive); branches of the index beyond them are not read."""
        address = self.address if node is None else node
        if address == UNDEFINED:
            return
        c = self.container
        _, kind, level, used = struct.unpack("<4sBBH", c.fetch(address, 8))
        rank = len(self.shape)
        key = 8 + 8 * (rank + 1)
        raw = c.fetch(address + 24, used * (key + 8) + key)
        for k in range(used):
            at = k * (key + 8)
            size, skipped = struct.unpack_from("<II", raw, at)
            start = struct.unpack_from(f"<{rank}Q", raw, at + 8)
            (child,) = struct.unpack_from("<Q", raw, at + key)
            (after,) = struct.unpack_from("<Q", raw, at + key + 8 + 8)  # first row of the next key
            if start[0] >= last or (after if level else start[0]) + self.band <= first:
                continue
            if level:
                yield from self.chunks(first, last, child)
            else:
                yield Chunk(child, size, skipped, start)

    def _decoded(self, chunk: Chunk) -> np.ndarray:
        raw = self.container.fetch(chunk.address, chunk.size)
        for k in range(len(self.filters) - 1, -1, -1):
            kind, values = self.filters[k]
            if chunk.skipped >> k & 1:
                continue
            if kind == CHECKSUM:
                raw = raw[:-4]
            elif kind == DEFLATE:
                raw = zlib.decompress(raw)
            else:
                n = values[0] if values else self.dtype.itemsize
                whole = len(raw) // n * n
                raw = np.frombuffer(raw, np.uint8, whole).reshape(n, -1).T.tobytes() + raw[whole:]
        return np.frombuffer(raw, self.dtype, int(np.prod(self.chunk))).reshape(self.chunk)

    def rows(self, first: int, last: int) -> np.ndarray:
        """(rows, width) of a range of rows."""
        n = last - first
        if self.kind == COMPACT:
            return np.frombuffer(self.content, self.dtype, len(self.content) // self.dtype.itemsize).reshape(self.shape[0], self.width)[first:last]
        if self.kind == CONTIGUOUS:
            if self.address == UNDEFINED:
                return np.full((n, self.width), self.fill, self.dtype)
            step = self.width * self.dtype.itemsize
            return np.frombuffer(self.container.fetch(self.address + first * step, n * step), self.dtype).reshape(n, self.width)
        out = np.full((n, *self.shape[1:]), self.fill, self.dtype)
        for chunk in self.chunks(first, last):
            part = self._decoded(chunk)
            low = [max(s, a) for s, a in zip(chunk.start, (first, *[0] * (len(self.shape) - 1)), strict=True)]
            high = [min(s + w, b) for s, w, b in zip(chunk.start, self.chunk, (last, *self.shape[1:]), strict=True)]
            to = tuple(slice(a - (first if k == 0 else 0), b - (first if k == 0 else 0)) for k, (a, b) in enumerate(zip(low, high, strict=True)))
            out[to] = part[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, chunk.start, strict=True))]
        return out.reshape(n, self.width)


_SPARK = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}


def _spark_type(dtype: np.dtype) -> T.DataType:
    return _SPARK[f"{dtype.kind}{dtype.itemsize}"]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    path: str
    first: int
    last: int


def _range(text: str | None, n: int) -> tuple[int, int]:
    first, _, last = (text or ":").partition(":")
    return min(int(first or 0), n), min(int(last), n) if last else n


class Hdf5Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[Rows]:
        out = []
        limit = int(self.options.get("partitionbytes", PARTITION_BYTES))
        for path in listed(self.options["path"], ENDINGS):
            container = Container(path)
            data = container.dataset(self.options.get("dataset"))
            first, last = _range(self.options.get("rows"), data.shape[0] if data.shape else 0)
            band = data.band
            step = max(band, limit // max(1, data.width * data.dtype.itemsize) // band * band)
            at = first
            while at < last:
                end = min(last, (at // step + 1) * step)
                out.append(Rows(path, at, end))
                at = end
            container.close()
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        container = Container(partition.path)
        data = container.dataset(self.options.get("dataset"))
        kind = _arrow_type(self.schema["values"].dataType.elementType)
        # whole chunks are decoded once each; the rows of one band are the least that is held
        step = max(data.band, BATCH_VALUES // max(1, data.width) // data.band * data.band)
        at = partition.first
        while at < partition.last:
            end = min(partition.last, (at // step + 1) * step)
            values = data.rows(at, end)
            if data.dtype.byteorder not in "=|" or data.dtype.newbyteorder("=") != data.dtype:
                values = values.astype(data.dtype.newbyteorder("="))
            flat = pa.array(values.ravel()) if data.dtype.str[1:] != "u8" else pa.array([int(v) for v in values.ravel()], pa.decimal128(20, 0))
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - at + 1) * data.width if data.width else 1, data.width or 1, dtype=np.int32) if data.width else np.zeros(end - at + 1, np.int32)), flat.cast(kind))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (end - at), pa.string()), pa.array(np.arange(at, end, dtype=np.int64)), column], ["file", "row", "values"])
            at = end
        container.close()


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body


def _described(dtype: np.dtype) -> bytes:
    """The datatype message of little-endian numbers."""
    if dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
    exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[dtype.itemsize]
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * dtype.itemsize - 1, 0, dtype.itemsize, 0, 8 * dtype.itemsize, mantissa, exponent, 0, mantissa, bias)


class ContainerBuilder:
    """A container of chunked, deflated datasets in one root group, built in memory."""

    def __init__(self):
        self.raw = bytearray(96)  # the superblock comes last
        self.headers: dict[str, int] = {}

    def _append(self, content: bytes) -> int:
        self.raw += bytes(-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += content
        return at

    def add(self, name: str, array: np.ndarray, chunk: tuple[int, ...], level: int = 4) -> None:
        """Store an array of numbers in chunks; those at the border are filled up with zeros."""
        array = array.astype(array.dtype.newbyteorder("<"))
        grid = [range(0, n, c) for n, c in zip(array.shape, chunk, strict=True)]
        entries = []
        for flat in range(int(np.prod([len(g) for g in grid], dtype=np.int64))):
            start = tuple(int(g[k]) for g, k in zip(grid, np.unravel_index(flat, [len(g) for g in grid]), strict=True))
            part = array[tuple(slice(s, s + c) for s, c in zip(start, chunk, strict=True))]
            full = np.zeros(chunk, array.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            shuffled = np.frombuffer(full.tobytes(), np.uint8).reshape(-1, array.itemsize).T.tobytes()
            packed = zlib.compress(shuffled, level)
            entries.append((struct.pack(f"<II{len(start) + 1}Q", len(packed), 0, *start, 0), self._append(packed)))
        end = struct.pack(f"<II{len(chunk) + 1}Q", 0, 0, *(len(g) * c for g, c in zip(grid, chunk, strict=True)), 0)
        tree = self._tree(entries, end) if entries else UNDEFINED
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", SHUFFLE, 0, 0, 1, array.itemsize, 0) + struct.pack("<HHHHII", DEFLATE, 0, 0, 1, level, 0)
        self.headers[name] = self._append(
            _header(
                _message(DATASPACE, struct.pack(f"<BBB5x{array.ndim}Q", 1, array.ndim, 0, *array.shape)),
                _message(DATATYPE, _described(array.dtype)),
                _message(FILL, struct.pack("<BBBB", 2, 3, 2, 0)),
                _message(LAYOUT, struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, CHUNKED, len(chunk) + 1, tree, *chunk, array.itemsize)),
                _message(FILTERS, filters),
            )
        )

    def _tree(self, entries: list[tuple[bytes, int]], end: bytes) -> int:
        """The root address of a B-tree over (key, address) pairs in order."""
        level = 0
        while True:
            groups = [entries[k : k + NODE_ENTRIES] for k in range(0, len(entries), NODE_ENTRIES)]
            size = 24 + NODE_ENTRIES * (len(end) + 8) + len(end)
            self.raw += bytes(-len(self.raw) % 8)
            places = [len(self.raw) + k * (size + -size % 8) for k in range(len(groups))]
            for k, group in enumerate(groups):
                left, right = places[k - 1] if k else UNDEFINED, places[k + 1] if k + 1 < len(groups) else UNDEFINED
                last = groups[k + 1][0][0] if k + 1 < len(groups) else end
                node = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(group), left, right) + b"".join(key + struct.pack("<Q", at) for key, at in group) + last
                self._append(node + bytes(size + -size % 8 - len(node)))
            if len(groups) == 1:
                return places[0]
            entries, level = [(group[0][0], at) for group, at in zip(groups, places, strict=True)], level + 1

    def finish(self) -> bytes:
        """The whole file."""
        names, offsets = bytearray(8), {}
        for name in sorted(self.headers):
            offsets[name] = len(names)
            names += name.encode() + b"\0"
            names += bytes(-len(names) % 8)
        if len(self.headers) > GROUP_ENTRIES:
            raise ValueError(f"at most {GROUP_ENTRIES} datasets")
        free = len(names)
        names += struct.pack("<QQ", 1, 16)  # the free rest of the heap
        segment = self._append(bytes(names))
        heap = self._append(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), free, segment))
        rows = b"".join(struct.pack("<QQII16x", offsets[n], self.headers[n], 0, 0) for n in sorted(self.headers))
        node = self._append((struct.pack("<4sBBH", b"SNOD", 1, 0, len(self.headers)) + rows).ljust(8 + 40 * GROUP_ENTRIES, b"\0"))
        last = offsets[max(self.headers)] if self.headers else 0
        tree = self._append((struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, last)).ljust(24 + 32 * 16 + 8, b"\0"))
        root = self._append(_header(_message(SYMBOLS, struct.pack("<QQ", tree, heap))))
        self.raw[:96] = SIGNATURE + struct.pack("<BBBBBBBBHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, GROUP_ENTRIES // 2, 16, 0, 0, UNDEFINED, len(self.raw), UNDEFINED) + struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap)
        return bytes(self.raw)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Hdf5Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        if set(schema.names) != {"row", "values"}:
            raise ValueError("a container takes the columns row and values")
        self.options, self.parts = dict(options), Parts(options["path"], ".h5", overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, limit, names = TaskContext.get(), int(self.options.get("filebytes", FILE_BYTES)), []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if held:
                builder = ContainerBuilder()
                row, values = (np.concatenate([h[k] for h in held]) for k in range(2))
                chunk = int(self.options.get("chunkrows", 0)) or max(1, min(len(row), BATCH_VALUES // max(1, values.shape[1])))
                builder.add("row", row, (min(chunk, len(row)),))
                builder.add("values", values, (min(chunk, len(row)), max(1, values.shape[1])))
                names.append(self.parts.put(builder.finish(), task.partitionId() if task else 0))
                held.clear()

        for batch in iterator:
            row = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("values")
            if lists.null_count or batch.column("row").null_count or lists.flatten().null_count:
                raise ValueError("a container holds no nulls")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(sizes) > 1 or (held and len(row) and held[0][1].shape[1] != sizes[0]):
                raise ValueError("values of one length are needed")
            if len(row):
                held.append((row, values.reshape(len(row), -1)))
            if sum(h[1].nbytes for h in held) >= limit:
                flush()
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        self.parts.commit([name for m in messages if m for name in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        self.parts.abort()


class Hdf5(DataSource):
    """Options: path (a file or a folder), dataset (default: the first by name), rows (first:last), partitionBytes; for writes chunkRows and fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> T.StructType:
        container = Container(listed(self.options["path"], ENDINGS)[0])
        kind = _spark_type(container.dataset(self.options.get("dataset")).dtype)
        container.close()
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("values", T.ArrayType(kind))])

    def reader(self, schema: T.StructType) -> Hdf5Reader:
        return Hdf5Reader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format hdf5 known to a session."""
    spark.dataSource.register(Hdf5)


def subject_images(spark: SparkSession, path: str, images=None, dataset: str | None = None):
    """(image_ix, px) of an image container; images(image_ix, ...) restricts it to the span of rows and then to the rows wanted."""
    from pyspark.sql import functions as F

    register(spark)
    read = spark.read.format("hdf5").option("path", path)
    if dataset:
        read = read.option("dataset", dataset)
    if images is None:
        return read.load().select(F.col("row").alias("image_ix"), F.transform("values", lambda x: x.cast("double")).alias("px"))
    low, high = images.agg(F.coalesce(F.min("image_ix"), F.lit(0)), F.coalesce(F.max("image_ix"), F.lit(-1))).first()
    rows = read.option("rows", f"{low}:{high + 1}").load().select(F.col("row").alias("image_ix"), F.transform("values", lambda x: x.cast("double")).alias("px"))
    return rows.join(images.select("image_ix").distinct(), "image_ix", "left_semi")
