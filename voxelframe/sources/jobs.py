"""The whole fit of a model as a resumable job over blocks of channels and slices of iterations.

Every part (stage, block) is written to a folder of its own and moved into
place by one rename, so a part is either whole or absent, and the folders are
the manifest of what is finished. A job that is started again makes only the
parts that are absent, from the stored parts that they follow from. The job's
settings are kept beside them; other settings for the same folder are an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M

STAGES = ("fits", "validation", "residuals", "permutation", "bootstrap")


class Run:
    """The folder of a job."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        text = json.dumps(settings, sort_keys=True)
        if self._there(f"{self.path}/settings"):
            found = spark.read.text(f"{self.path}/settings", wholetext=True).first()
            if found is None or found[0].strip() != text:
                raise ValueError(f"{self.path} holds a job with other settings")
        else:
            self._moved(spark.createDataFrame([(text,)], "value string").coalesce(1).write.text, "settings")

    def _there(self, path: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _moved(self, write: Callable[[str], None], name: str) -> None:
        """Write to a temporary folder, then rename it to its name; of two that write the same name the first stays."""
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        write(draft)
        target = of(f"{self.path}/{name}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(of(draft), target):
            self._fs.delete(of(draft), True)

    def part(self, stage: str, block: int, make: Callable[[], DataFrame]) -> DataFrame:
        """The part's table; made and stored first if it is absent."""
        name = f"{stage}/block={block}"
        if not self._there(f"{self.path}/{name}"):
            self._moved(make().write.parquet, name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def finished(self) -> list[tuple[str, int]]:
        """The manifest: every finished part."""
        out = []
        for stage in STAGES:
            if self._there(f"{self.path}/{stage}"):
                out += [(stage, int(f.getPath().getName().removeprefix("block="))) for f in self._fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stage}"))]
        return sorted(out, key=lambda p: (STAGES.index(p[0]), p[1]))

    def table(self, stage: str) -> DataFrame:
        """All finished parts of a stage, with their block."""
        return self.spark.read.parquet(f"{self.path}/{stage}")


def fit_job(
    features: DataFrame, responses: DataFrame, penalties: list[float], path: str, masks: dict[str, list[int]] | None = None, blocks: int = 1, permutations: int = 0, bootstraps: int = 0, together: int = 100, keep_residuals: bool = False, fields: DataFrame | None = None
) -> Run:
    """Fits, validates and tests a model of features(prf_ix, image_ix, split, f) and responses(image_ix, voxel_ix, y).

    Channels are dealt to blocks by a hash of their number, iterations to slices
    of `together`; each slice draws what one run of all iterations would. Stages:
    fits (each channel's best field, all versions), validation (n, cc, r2),
    residuals of all images, and permutation and bootstrap (cc and r2 of every
    iteration's refit at the channel's field; their block is that of the
    channels times the number of slices, plus the slice).
    """
    settings = {"penalties": [float(p) for p in penalties], "masks": {k: list(v) for k, v in (masks or {}).items()}, "blocks": blocks, "permutations": permutations, "bootstraps": bootstraps, "together": together, "residuals": keep_residuals}
    run = Run(features.sparkSession, path, settings)
    val = features.where("split = 'val'")
    for b in range(blocks):
        mine = responses.where(F.pmod(F.xxhash64("voxel_ix"), F.lit(blocks)) == b)
        fits = run.part("fits", b, lambda: M.best_field(M.fit_ridge(features, mine, penalties, masks, fields=fields)))  # noqa: B023
        run.part("validation", b, lambda: M.validate(M.predict(val, fits), mine))  # noqa: B023
        if keep_residuals:
            run.part("residuals", b, lambda: M.residuals(M.predict(features, fits), mine))  # noqa: B023
        chosen = fits.select("voxel_ix", "prf_ix").distinct()
        for stage, iterations in (("permutation", permutations), ("bootstrap", bootstraps)):
            slices = -(-iterations // together)
            for s in range(slices):
                start = s * together

                def scores(stage=stage, start=start, n=min(together, iterations - start), mine=mine, chosen=chosen):
                    _, found = M.refit(features, mine, penalties, chosen, n, masks, bootstrap=stage == "bootstrap", seed=start)
                    return found.withColumn("iter", F.col("iter") + start)

                run.part(stage, b * slices + s, scores)
    return run


def permutation_p(run: Run) -> DataFrame:
    """(voxel_ix, version, cc, p): the share of permuted refits that correlate at least as well as the fit, which counts as one of them."""
    null = run.table("permutation").select("voxel_ix", "version", F.col("cc").alias("null"))
    both = run.table("validation").select("voxel_ix", "version", "cc").join(null, ["voxel_ix", "version"])
    return both.groupBy("voxel_ix", "version", "cc").agg(((F.count_if(F.coalesce("null", F.lit(0.0)) >= F.coalesce("cc", F.lit(0.0))) + 1) / (F.count("*") + 1)).alias("p"))
