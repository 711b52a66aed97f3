"""Readers with explicit schemas, and the run folders of stored fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuple_column(text: Column) -> Column:
    """'(0.1, 0, 0.2, 0)' as array<double>."""
    return F.from_json(F.translate(text, "()", "[]"), "array<double>")


def image_info(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata CSV(coco_id, crop_box '(a, b, c, d)', coco_split, filename_raw)."""
    rows = spark.read.csv(path, header=True, schema="coco_id long, crop_box string, coco_split string, filename_raw string")
    return rows.withColumn("crop_box", tuple_column(F.col("crop_box")))


ANNOTATIONS = "annotations array<struct<image_id:long,category_id:int,bbox:array<double>,iscrowd:int>>, categories array<struct<id:int,name:string,supercategory:string>>"


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, categories) of annotation JSON files."""
    whole = spark.read.json(path, schema=ANNOTATIONS, multiLine=True)
    return whole.select(F.explode("annotations").alias("a")).select("a.*"), whole.select(F.explode("categories").alias("c")).select("c.*")


def category_info(categories: DataFrame) -> DataFrame:
    """Sorted category names and ids for each supercategory."""
    return categories.groupBy("supercategory").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("members"))


def label_colours(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a colour-table text file: lines 'id name r g b a'."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line.rlike(r"^\d+\s+\S+"))
    return rows.select(F.regexp_extract(line, r"^(\d+)", 1).cast("int").alias("id"), F.regexp_extract(line, r"^\d+\s+(\S+)", 1).alias("name"))


def array_files(spark: SparkSession, path: str, slice_: int = 1_000_000) -> DataFrame:
    """(path, shape, start, values) of .npy files with numeric arrays: slices of the unrolled values from start on."""
    import io

    import numpy as np
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                flat = a.ravel()
                for start in range(0, max(len(flat), 1), slice_):
                    values = pa.array(flat[start : start + slice_].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["path", "shape", "start", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, shape array<long>, start long, values array<double>")


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, value) of uncompressed or gzipped NIfTI-1 volumes, scaled by slope and intercept.

    A fourth dimension gives rows of t; voxels are unrolled first index fastest.
    """
    import gzip
    import struct

    import numpy as np
    import pyarrow as pa

    # NIfTI-1 data type codes.
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8"}

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
                dims = struct.unpack(f"{order}8h", raw[40:56])
                kind = np.dtype(order + kinds[struct.unpack(f"{order}h", raw[70:72])[0]])
                offset, slope, base = struct.unpack(f"{order}3f", raw[108:120])
                shape = [max(1, d) for d in dims[1 : dims[0] + 1]] + [1] * (4 - dims[0])
                values = np.frombuffer(raw, kind, int(np.prod(shape)), int(offset)).astype(float) * (slope or 1.0) + base
                index = np.unravel_index(np.arange(len(values)), shape, order="F")
                for k in range(0, len(values), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values[part])), *(pa.array(x[part].astype(np.int32)) for x in index[:4]), pa.array(values[part])], ["path", "i", "j", "k", "t", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, i int, j int, k int, t int, value double")


def recast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with some columns in other types; itself when nothing differs."""
    now = dict(df.dtypes)
    return df if all(now[c] == t for c, t in kinds.items()) else df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def folder_time(name: Column) -> Column:
    """Time of a run folder: Jan-31-2021_1205_30, or without seconds."""
    return F.coalesce(F.try_to_timestamp(name, F.lit("MMM-dd-yyyy_HHmm_ss")), F.try_to_timestamp(name, F.lit("MMM-dd-yyyy_HHmm")))


def recent_runs(folders: DataFrame, by: list[str], name: str, n_from_end: int = 0) -> DataFrame:
    """The n-th latest run folder of each key, without notebook and debug folders."""
    at = folder_time(F.col(name))
    rows = folders.where(~F.col(name).contains("ipynb") & ~F.col(name).contains("DEBUG")).withColumn("run_time", at).where("run_time is not null")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("run_time"), name))
    return rows.withColumn("__r", rank).where(F.col("__r") == n_from_end + 1).drop("__r")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A Parquet table that is pruned by its partition columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
