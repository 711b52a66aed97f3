"""Image ingest: files of any format that the JVM decodes, cropped, resized and stored by number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import crop_box_pixels, square_crop

#: Stored pixels are unrolled by row, column and channel.
STORED = "image_ix long, w int, channels int, px array<short>"
#: Pixels to a row group, so that a read of some images skips the others.
GROUP_BYTES = 4 << 20
BATCH_ROWS = 64


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, w, channels, data) of the readable images under a path; data is blue, green, red (, alpha) by row and column."""
    image = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif,PNG,JPG,JPEG}").load(path)
    return image.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def resampling(size: int, new: int, kernel: str = "bilinear") -> np.ndarray:
    """(new, size) weights of a resize along one axis, widened over all source pixels where it shrinks; rows sum to 1."""
    scale = size / new
    wide = max(scale, 1.0)
    reach = {"box": 0.5, "bilinear": 1.0, "lanczos": 3.0}[kernel]
    centre = (np.arange(new) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    if kernel == "box":
        edge = lambda e: np.clip(e, 0, size)  # noqa: E731  # the share of each pixel that the box covers
        low, high = edge(centre - 0.5 * wide)[:, None], edge(centre + 0.5 * wide)[:, None]
        w = np.clip(np.minimum(high, np.arange(size) + 1) - np.maximum(low, np.arange(size)), 0, None)
    elif kernel == "bilinear":
        w = np.clip(1 - np.abs(x), 0, None)
    else:
        w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, size: int, kernel: str = "bilinear") -> np.ndarray:
    """(size, size, channels) of whole numbers from 0 to 255."""
    rows, columns = resampling(image.shape[0], size, kernel), resampling(image.shape[1], size, kernel)
    out = np.einsum("ij,jkc,lk->ilc", rows, image.astype(float), columns, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int16)


def ingested(images: DataFrame, size: int, channels: int = 3, kernel: str = "bilinear") -> DataFrame:
    """(image_ix, w, channels, px) of images(image_ix, height, w, channels, data, crop_box).

    crop_box: fractions cut from top, bottom, left and right; null cuts the
    longer side evenly to a square. Of gray images the one channel is repeated,
    alpha is left out, and with channels = 1 the first (red) one is kept.
    Images that nothing is left of have no row.
    """
    side = lambda k: F.get("crop_box", F.lit(k))
    square = square_crop(F.col("height"), F.col("w"))
    box = crop_box_pixels([F.coalesce(side(k), square[k]) for k in range(4)], F.col("height"), F.col("w"))
    rows = images.select("image_ix", "height", "w", "channels", *[b.cast("int").alias(n) for b, n in zip(box, ("top", "bottom", "left", "right"), strict=True)], "data")
    rows = rows.where("bottom > top and right > left and top >= 0 and left >= 0")

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                made = []
                for r in part.to_pylist():
                    a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["w"], r["channels"])
                    a = a[r["top"] : r["bottom"], r["left"] : r["right"]]
                    a = np.repeat(a[..., :1], 3, axis=2) if r["channels"] < 3 else a[..., 2::-1]
                    made.append(resized(a[..., :channels], size, kernel).ravel())
                n, each = len(made), size * size * channels
                px = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * each, each, dtype=np.int32)), pa.array(np.concatenate(made), pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([size] * n, pa.int32()), pa.array([channels] * n, pa.int32()), px], ["image_ix", "w", "channels", "px"])

    return rows.mapInArrow(work, STORED)


def store_images(images: DataFrame, path: str, per_file: int = 1000) -> None:
    """Ranges of image_ix to a file, in order, in small row groups."""
    n = images.select("image_ix").count()
    rows = images.repartitionByRange(max(1, -(-n // per_file)), "image_ix").sortWithinPartitions("image_ix")
    rows.write.mode("overwrite").option("parquet.block.size", str(GROUP_BYTES)).parquet(path)


def stored_images(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """(image_ix, w, channels, px) of a store, px as doubles; of images(image_ix), only files and row groups that their span meets are read."""
    rows = spark.read.schema(STORED).parquet(path)
    if images is not None:
        low, high = images.agg(F.min("image_ix"), F.max("image_ix")).first()
        rows = rows.where(F.col("image_ix").between(low, high) if low is not None else F.lit(False)).join(images.select("image_ix").distinct(), "image_ix", "left_semi")
    return rows.withColumn("px", F.transform("px", lambda v: v.cast("double")))


def file_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def ingest(spark: SparkSession, files: DataFrame, folder: str, out: str, size: int = 240, channels: int = 3, kernel: str = "bilinear") -> DataFrame:
    """Stores the images of files(image_ix, filename[, crop_box]) from a folder, and returns the rows of files that had no readable image.

    Decoding is the JVM's; crop and resize are one product of matrices for each
    image. A file that several rows name is stored for each.
    """
    files = files if "crop_box" in files.columns else files.withColumn("crop_box", F.lit(None).cast("array<double>"))
    found = decoded(spark, folder).withColumn("__file", file_name("path")).drop("path")
    named = files.select("image_ix", "crop_box", file_name("filename").alias("__file"))
    store_images(ingested(named.join(found, "__file"), size, channels, kernel), out)
    return files.join(spark.read.schema(STORED).parquet(out).select("image_ix"), "image_ix", "left_anti")


def localizer_files(counts: dict[str, int], stems: dict[str, tuple[str, int]] | None = None) -> list[tuple[int, str, int, str]]:
    """(image_ix, category, instance, file name) of a localizer set: category-1.jpg and so on, categories in order.

    stems names the files of categories that have another stem or go on counting from a number.
    """
    out = []
    for category, n in counts.items():
        stem, base = (stems or {}).get(category, (category, 0))
        out += [(len(out) + k, category, k + 1, f"{stem}-{base + k + 1}.jpg") for k in range(n)]
    return out


def subject_cut(spark: SparkSession, path: str, subjects: DataFrame, out: str, per_file: int = 1000) -> None:
    """Writes each subject's own images, out/subject=<s>, from a store: subjects(subject, place, image_ix) says which image is at which place.

    The store is read once; an image goes to every subject that saw it.
    """
    rows = spark.read.schema(STORED).parquet(path).join(subjects.select("subject", "place", "image_ix"), "image_ix")
    rows = rows.select("subject", F.col("place").alias("image_ix"), "w", "channels", "px")
    block = F.floor(F.col("image_ix") / per_file)
    rows.repartition("subject", block).sortWithinPartitions("subject", "image_ix").write.mode("overwrite").option("parquet.block.size", str(GROUP_BYTES)).partitionBy("subject").parquet(out)

