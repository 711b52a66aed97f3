"""Regions of interest: tables (subject, voxel_ix, roi) with names by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trials import concatenated


def roi_of(labels: dict[str, Column], order: list[str]) -> Column:
    """Label of a voxel from several definitions, the first of order that sets one (positive), as 'definition:number'; null without."""
    return F.coalesce(*[F.when(labels[name] > 0, F.concat(F.lit(f"{name}:"), labels[name].cast("string"))) for name in order])


def members(rois: DataFrame, names: DataFrame, roi: int | None = None, name: str | None = None) -> DataFrame:
    """Voxels of a region by number or by name, with names(roi, name); of several regions that share the name, all."""
    if (roi is None) == (name is None):
        raise ValueError("give a number or a name")
    if roi is not None:
        return rois.where(F.col("roi") == roi)
    return rois.join(F.broadcast(names.where(F.col("name") == name).select("roi").distinct().limit(10_000)), "roi", "left_semi")


def all_subjects(subjects: dict[str, DataFrame]) -> DataFrame:
    """Regions of several subjects in order, voxels numbered on: (subject, voxel_ix, roi)."""
    return concatenated(subjects, "voxel_ix")


def voxel_table(maps: DataFrame, names: list[str], order: list[str], ceiling: str, least: float = 0.0) -> DataFrame:
    """(voxel_ix, label, ceiling) of the voxels in any region or with a noise ceiling over least; one pivot of maps(voxel_ix, name, value)."""
    wide = maps.groupBy("voxel_ix").pivot("name", [*names, ceiling]).agg(F.first("value"))
    labels = {n: F.col(f"`{n}`").cast("int") for n in names}
    out = wide.select("voxel_ix", roi_of(labels, order).alias("label"), F.col(f"`{ceiling}`").alias("ceiling"))
    return out.where(F.col("label").isNotNull() | (F.col("ceiling") > least))


def roi_map(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Every cell(voxel_ix) of a volume with its region, null outside."""
    return cells.join(rois.select("voxel_ix", "roi"), "voxel_ix", "left")
