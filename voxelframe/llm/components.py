"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Stage


def connected_components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(id, component) for every id of edges(a, b); component is the smallest id reachable.

    Each round takes the least label among the neighbours (partly aggregated
    before the shuffle, so a hub is no hot key) and then follows the label's
    own label; chains halve each round. Rows with a null end must be left out
    by the caller. An empty edge table gives an empty result.
    """
    both = stage.put(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-both")
    labels = stage.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    last = f"{name}-labels"
    for k in range(1000):
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        new = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        new = stage.put(new, f"{name}-{k}")
        jumped = new.join(new.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left")
        labels = stage.put(jumped.select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), f"{name}-{k}-jumped")
        stage.drop(last, f"{name}-{k}")
        last = f"{name}-{k}-jumped"
        if not labels.where("component <> was").limit(1).count():
            return labels.select("id", "component")
    raise RuntimeError("components did not settle")
