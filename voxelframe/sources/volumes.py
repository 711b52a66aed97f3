"""Volumes of voxels: NIfTI-1 and MGH files, plain or gzipped, as rows of cells, and cells as NIfTI-1 files."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from ..operators.joins import prior
from .files import Parts
from .hdf5 import Written

#: Voxels to an Arrow batch, and to a compressed slab of a written file.
BATCH, SLAB = 100_000, 1 << 18
# Data type codes of NIfTI-1 and MGH, and the sizes of their headers.
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8"}
MGH = {0: "u1", 1: "i4", 3: "f4", 4: "i2"}
NIFTI_BYTES, MGH_BYTES = 348, 284


def _opened(content: bytes):
    """The bytes as a stream; gzipped ones are unpacked as far as they are read."""
    raw = io.BytesIO(content)
    return gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw


def _described(stream) -> tuple[list[int], np.dtype, float, float]:
    """(shape of four dimensions, number type, slope, intercept); the stream stands at the first voxel afterwards."""
    head = stream.read(MGH_BYTES)
    if struct.unpack(">i", head[:4])[0] == 1:
        *shape, kind = struct.unpack(">5i", head[4:24])
        return [max(1, d) for d in shape], np.dtype(MGH[kind]).newbyteorder(">"), 1.0, 0.0
    head += stream.read(NIFTI_BYTES - MGH_BYTES)
    order = "<" if struct.unpack("<i", head[:4])[0] == NIFTI_BYTES else ">"
    if struct.unpack(f"{order}i", head[:4])[0] != NIFTI_BYTES:
        raise ValueError("neither a NIfTI-1 nor an MGH volume")
    dims = struct.unpack(f"{order}8h", head[40:56])
    kind = np.dtype(NIFTI[struct.unpack(f"{order}h", head[70:72])[0]]).newbyteorder(order)
    offset, slope, base = struct.unpack(f"{order}3f", head[108:120])
    stream.read(int(offset) - NIFTI_BYTES)
    return [max(1, d) for d in dims[1 : dims[0] + 1]] + [1] * (4 - dims[0]), kind, slope or 1.0, base


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, t, value) of volumes, scaled by slope and intercept, the first index fastest; unpacked slab by slab."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = _opened(content.as_buffer().to_pybytes())
                shape, kind, slope, base = _described(stream)
                count = int(np.prod(shape, dtype=np.int64))
                for start in range(0, count, BATCH):
                    n = min(BATCH, count - start)
                    values = np.frombuffer(stream.read(n * kind.itemsize), kind, n).astype(float) * slope + base
                    index = np.unravel_index(np.arange(start, start + n), shape, order="F")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(pa.array(x.astype(np.int32)) for x in index[:4]), pa.array(values)], ["path", "i", "j", "k", "t", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, i int, j int, k int, t int, value double")


def merged_labels(maps: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """(i, j, k, value): at each cell of label volumes(i, j, k, value), the label of the first one in order that sets it (not null, not 0)."""
    rows = None
    for name in order:
        one = maps[name].select("i", "j", "k", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
        rows = one if rows is None else rows.union(one)
    wide = rows.groupBy("i", "j", "k").pivot("name", order).agg(F.max("value"))
    return wide.select("i", "j", "k", F.coalesce(prior(*[F.col(f"`{n}`") for n in order]), F.lit(0.0)).alias("value"))


def slabs(cells: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(volume, slab, content): the voxels of cells(volume, i, j, k, value) as float32 slabs of SLAB voxels, each a gzip member of its own.

    Cells that are not given are 0; of several values of a cell the greatest
    counts; cells outside of the shape, and null values, are left out. A slab is
    the most that a task holds.
    """
    a, b, c = shape
    count = a * b * c
    inside = F.col("i").between(0, a - 1) & F.col("j").between(0, b - 1) & F.col("k").between(0, c - 1)
    at = F.col("i").cast("long") + a * (F.col("j").cast("long") + b * F.col("k").cast("long"))
    known = cells.where(inside & F.col("value").isNotNull()).select("volume", F.floor(at / SLAB).cast("int").alias("slab"), (at % SLAB).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    # one row without a voxel for every slab, so that none is missing
    every = cells.select("volume").distinct().select("volume", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // SLAB))).alias("slab"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("value"))

    def pack(table: pa.Table) -> pa.Table:
        slab = table.column("slab")[0].as_py()
        values = table.column("value").to_numpy()
        keep = ~np.isnan(values)
        place, values = table.column("at").to_numpy()[keep], values[keep]
        order = np.argsort(values, kind="stable")  # the greatest is written last
        out = np.zeros(min(SLAB, count - slab * SLAB), "<f4")
        out[place[order]] = values[order]
        return pa.table({"volume": table.column("volume").slice(0, 1), "slab": pa.array([slab], pa.int32()), "content": pa.array([gzip.compress(out.tobytes(), 4, mtime=0)], pa.binary())})

    return known.union(every).groupBy("volume", "slab").applyInArrow(pack, "volume string, slab int, content binary")


class NiftiWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.shape = tuple(int(d) for d in options["shape"].split(","))
        self.parts = Parts(options["path"], ".nii.gz", overwrite)

    def header(self) -> bytes:
        head = bytearray(352)
        struct.pack_into("<i", head, 0, NIFTI_BYTES)
        struct.pack_into("<8h", head, 40, 3, *self.shape, 1, 1, 1, 1)
        struct.pack_into("<hh", head, 70, 16, 32)
        struct.pack_into("<8f", head, 76, *[1.0] * 8)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        head[344:348] = b"n+1\0"
        return gzip.compress(bytes(head), 4, mtime=0)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Joins the gzip members of each volume, which come in order, behind the header's."""
        names, now, held = [], None, []

        def flush():
            if held:
                names.append(self.parts.put(b"".join([self.header(), *held]), 0, now))
                held.clear()

        for batch in iterator:
            for volume, content in zip(batch.column("volume").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if volume != now:
                    flush()
                    now = volume
                held.append(content)
        flush()
        return Written(names)

    def commit(self, messages) -> None:
        self.parts.commit([name for m in messages if m for name in m.names])

    def abort(self, messages) -> None:
        self.parts.abort()


class Nifti(DataSource):
    """Writes (volume, slab, content) rows that come by volume and slab; options: path, shape."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def writer(self, schema, overwrite: bool) -> NiftiWriter:
        return NiftiWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_volumes(cells: DataFrame, path: str, shape: tuple[int, int, int], mode: str = "append") -> None:
    """A gzipped NIfTI-1 file path/<volume>.nii.gz of float32 for each volume of cells(volume, i, j, k, value).

    Slabs are packed where their cells are; one task joins a volume's packed
    slabs, and the commit moves the files of successful tasks.
    """
    cells.sparkSession.dataSource.register(Nifti)
    packed = slabs(cells, shape).repartition("volume").sortWithinPartitions("volume", "slab")
    packed.write.format("nifti").option("path", path).option("shape", ",".join(map(str, shape))).mode(mode).save()


def region_volumes(subjects: dict[str, dict[str, DataFrame]], order: list[str], path: str, shape: tuple[int, int, int]) -> None:
    """Writes each subject's label volumes, merged by priority, as one volume."""
    cells = None
    for subject, maps in subjects.items():
        one = merged_labels(maps, order).select(F.lit(subject).alias("volume"), "i", "j", "k", "value")
        cells = one if cells is None else cells.union(one)
    write_volumes(cells, path, shape)


def numbered_voxels(cells: DataFrame) -> DataFrame:
    """(volume, voxel_ix, i, j, k, value) of the cells that are not 0, numbered in the order of the volume, without sorting it in one task.

    Cells are counted by slice of k first; a number is the count of the slices
    before and the rank within the slice.
    """
    rows = cells.where("value != 0")
    before = Window.partitionBy("volume").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("volume", "k").count().select("volume", "k", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("volume", "k").orderBy("j", "i"))
    return rows.withColumn("rank", rank).join(counts, ["volume", "k"]).select("volume", (F.col("base") + F.col("rank") - 1).alias("voxel_ix"), "i", "j", "k", "value")
