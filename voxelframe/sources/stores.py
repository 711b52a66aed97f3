"""Stored features, images and fit results as Parquet folders, and image files."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import scaled
from .tables import recent_runs, write_partitioned

FEATURES = "prf_ix int, image_ix long, f array<double>"
IMAGES = "image_ix long, w int, px array<double>"


def write_features(df: DataFrame, path: str) -> None:
    """features(prf_ix, image_ix, f) by field, images in order, so that a read of some fields and images skips the rest."""
    rows = df.select("prf_ix", "image_ix", "f").repartition("prf_ix").sortWithinPartitions("prf_ix", "image_ix")
    write_partitioned(rows, path, ["prf_ix"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(path).select("prf_ix", "image_ix", "f")


def scaled_images(images: DataFrame, divide: float = 255.0) -> DataFrame:
    """images(image_ix, w, px) with values from 0 to 1."""
    return images.withColumn("px", scaled(F.col("px"), divide))


def noise_images(images: DataFrame, side: int, seed: int = 0, mean: float = 127.5, sd: float = 30.0) -> DataFrame:
    """An image of Gaussian noise for each of images(image_ix), that number, pixel and seed decide."""
    from ..functions.stats import inverse_normal
    from ..operators.sampling import MODULUS, draw

    share = lambda p: (draw(F.col("image_ix") * 65_537 + p, seed) + 0.5) / MODULUS
    px = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda p: mean + sd * inverse_normal(share(p)))
    return images.select("image_ix", F.lit(side).alias("w"), px.alias("px"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, w, channels, px) of images that the JVM decodes (see ingest) and of binary .ppm / .pgm files; px by row, column, red to blue."""
    import numpy as np
    import pandas as pd

    from .ingest import decoded

    schema = "path string, height int, w int, channels int, px array<double>"

    def turned(batches):
        for pdf in batches:
            px = []
            for data, c in zip(pdf.data, pdf.channels, strict=True):
                a = np.frombuffer(data, np.uint8).reshape(-1, c).astype(float)
                px.append((a if c < 3 else a[:, [2, 1, 0, *range(3, c)]]).ravel())
            yield pdf.drop(columns="data").assign(px=px)

    def read(batches):
        for pdf in batches:
            found = [_pnm(content) for content in pdf.content]
            yield pd.DataFrame([(name, *a.shape, a.astype(float).ravel()) for name, a in zip(pdf.path, found, strict=True)], columns=["path", "height", "w", "channels", "px"])

    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ppm,pgm}").load(path)
    return decoded(spark, path).mapInPandas(turned, schema).union(plain.select("path", "content").mapInPandas(read, schema))


def _pnm(raw: bytes):
    import re

    import numpy as np

    head = re.match(rb"(P[56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+255\s", raw)
    if not head:
        raise ValueError("not an image of 8-bit samples")
    channels = 3 if head[1] == b"P6" else 1
    w, h = int(head[2]), int(head[3])
    return np.frombuffer(raw, np.uint8, w * h * channels, head.end()).reshape(h, w, channels)


def result_path(root: str, subject: str, model: str, when: datetime.datetime, debug: bool = False) -> str:
    """Folder of a run: root/subject/model/Jan-31-2021_1205_30, with _DEBUG for trials."""
    return f"{root}/{subject}/{model}/{when.strftime('%b-%d-%Y_%H%M_%S')}{'_DEBUG' if debug else ''}"


def model_name(parts: list[str], field_fits: bool = True, pooled: bool = True) -> str:
    """Name of a model of several feature sets, in the order given."""
    return "_plus_".join(parts) + ("" if field_fits else "_precomputed_fields") + ("" if pooled else "_whole_image")


def fit_and_store(features: DataFrame, responses: DataFrame, penalties, root: str, subject: str, parts: list[str], when: datetime.datetime, masks: dict | None = None) -> str:
    """Fits all fields, keeps each channel's best one, validates it, and writes the tables fits and scores to the run's folder, which is returned."""
    from ..operators import models as M

    path = result_path(root, subject, model_name(parts), when)
    M.best_field(M.fit_ridge(features, responses, penalties, masks)).write.parquet(f"{path}/fits")
    fits = features.sparkSession.read.parquet(f"{path}/fits")
    M.validate(M.predict(features.where("split = 'val'"), fits), responses).write.parquet(f"{path}/scores")
    return path


def load_result(spark: SparkSession, root: str, subject: str, model: str, table: str, n_from_end: int = 0) -> DataFrame:
    """A table of the n-th latest run of a model; the folders are listed, their tables not read."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{subject}/{model}")
    names = [(f.getPath().getName(),) for f in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)]
    found = recent_runs(spark.createDataFrame(names, "name string").withColumn("k", F.lit(1)), ["k"], "name", n_from_end).first()
    if found is None:
        raise ValueError(f"no such run of {model}")
    return spark.read.parquet(f"{root}/{subject}/{model}/{found['name']}/{table}")
