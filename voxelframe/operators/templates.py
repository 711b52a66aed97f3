"""Orientation and curvature of templates: the best of a bank of straight and bent filters for each image."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import bent_kernel

#: Complex numbers of one product: images x kernels x pixels.
CELLS = 1 << 22
#: Responses are compared after rounding to so many places, so that ties go to the first kernel.
PLACES = 9
FOUND = "image_ix long, best_linear int, linear double, best_curved int, curved double"


@dataclass(frozen=True)
class Bank:
    """Kernels of every frequency, bend and angle (degrees), straight ones (bend 0) and bent ones, in that order."""

    frequencies: tuple[float, ...]
    bends: tuple[float, ...]
    angles: tuple[float, ...]
    size: int = 15

    @property
    def linear(self) -> list[tuple[float, float, float]]:
        return [(f, 0.0, a) for f, a in product(self.frequencies, self.angles)]

    @property
    def curved(self) -> list[tuple[float, float, float]]:
        return list(product(self.frequencies, [b for b in self.bends if b], self.angles))

    def spectra(self, which: list[tuple[float, float, float]], height: int, width: int) -> np.ndarray:
        """(kernels, height x width): transforms of the kernels, centred on the first pixel and scaled to unit norm; those larger than the image wrap around it."""
        out = np.zeros((len(which), height, width), complex)
        rows, columns = (np.arange(self.size) - self.size // 2) % height, (np.arange(self.size) - self.size // 2) % width
        for k, (frequency, bend, angle) in enumerate(which):
            kernel = bent_kernel(frequency, bend, angle, self.size)
            np.add.at(out[k], np.ix_(rows, columns), kernel / np.linalg.norm(kernel))
        return np.fft.fft2(out).reshape(len(which), -1)


def strongest(images: np.ndarray, spectra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kernel, response) of each image: the largest magnitude of any kernel at any place, whatever its phase; the first kernel on ties."""
    n, h, w = images.shape
    transformed = np.fft.fft2(images).reshape(n, 1, h * w)
    step = max(1, CELLS // max(1, n * h * w))
    peaks = [np.abs(np.fft.ifft2((transformed * spectra[None, k : k + step]).reshape(n, -1, h, w))).max(axis=(-2, -1)) for k in range(0, len(spectra), step)]
    responses = np.round(np.concatenate(peaks, axis=1), PLACES)
    best = responses.argmax(axis=1)
    return best, responses[np.arange(n), best]


def best_kernels(images: DataFrame, bank: Bank) -> DataFrame:
    """(image_ix, best_linear, linear, best_curved, curved): number and response of the best straight and bent kernel of images(image_ix, w, px).

    Images of one size are filtered together; the bank's transforms are made
    once for each task and size.
    """

    def search(batches):
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ix, widths = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                pixels = [np.asarray(part.column(2)[i].values.to_numpy(zero_copy_only=False), float) for i in range(part.num_rows)]
                sizes = [(len(p) // int(w), int(w)) for p, w in zip(pixels, widths, strict=True)]
                for size in sorted(set(sizes)):
                    if size not in known:
                        known[size] = [bank.spectra(which, *size) for which in (bank.linear, bank.curved)]
                    at = [i for i, s in enumerate(sizes) if s == size]
                    x = np.stack([pixels[i] for i in at]).reshape(len(at), *size)
                    (a, b), (c, d) = (strongest(x, s) for s in known[size])
                    yield pa.RecordBatch.from_arrays([pa.array(ix[at], pa.int64()), pa.array(a.astype(np.int32)), pa.array(b), pa.array(c.astype(np.int32)), pa.array(d)], ["image_ix", "best_linear", "linear", "best_curved", "curved"])

    return images.select("image_ix", "w", "px").where("size(px) > 0 and w > 0").mapInArrow(search, FOUND)


def template_table(images: DataFrame, bank: Bank, straight: DataFrame | None = None) -> DataFrame:
    """(image_ix, is_curved, frequency, bend, angle, response, best_linear, best_curved) of each template.

    Of the best straight and the best bent kernel the stronger one describes
    the template, the straight one on ties; straight(image_ix) are templates that
    only straight kernels may describe (double lines and junctions).
    """
    found = best_kernels(images, bank)
    found = found.withColumn("only", F.lit(False)) if straight is None else found.join(straight.select("image_ix", F.lit(True).alias("only")).distinct(), "image_ix", "left")
    found = found.withColumn("is_curved", ~F.coalesce("only", F.lit(False)) & (F.col("curved") > F.col("linear")))
    value = lambda k: F.when(F.col("is_curved"), F.get(F.array(*[F.lit(p[k]) for p in bank.curved]), F.col("best_curved"))).otherwise(F.get(F.array(*[F.lit(p[k]) for p in bank.linear]), F.col("best_linear")))
    return found.select("image_ix", "is_curved", *[value(k).alias(name) for k, name in enumerate(("frequency", "bend", "angle"))], F.when(F.col("is_curved"), F.col("curved")).otherwise(F.col("linear")).alias("response"), "best_linear", "best_curved")


def scored_top_images(best: DataFrame, images: DataFrame, bank: Bank) -> DataFrame:
    """best(image_ix, ...) with bent: how the strongest bent kernel's response to the image compares with the strongest straight one's.

    The keys come first: only their distinct images are read and filtered, each
    once, however many channels share it. Images without a response are null.
    """
    wanted = best.select("image_ix").distinct()
    scores = best_kernels(images.join(wanted, "image_ix", "left_semi"), bank)
    return best.join(scores.select("image_ix", F.try_divide("curved", F.nullif("linear", F.lit(0.0))).alias("bent")), "image_ix", "left")
