"""Registered feature sets: stored features or maps of any model, opened side by side with the masks of their versions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalogue import combined_features, combined_versions
from ..operators.trials import selected_features
from .stores import read_features


@dataclass(frozen=True)
class FeatureSet:
    """A stored feature table: its folder, the widths of its groups, and whether it has a row for each field (else one for the image)."""

    name: str
    path: str
    groups: dict[str, int] = field(default_factory=dict)
    by_field: bool = True


class FeatureSets:
    """Feature sets by name."""

    def __init__(self, *sets: FeatureSet):
        self.sets = {s.name: s for s in sets}
        if len(self.sets) != len(sets):
            raise ValueError("two sets share a name")

    def open(self, spark: SparkSession, names: list[str], images: DataFrame | None = None, fields: list[int] | None = None, solo: bool = True) -> tuple[DataFrame, dict[str, list[int]]]:
        """(features, masks) of some sets side by side: only the chosen fields and images are read; masks are of the combined model's versions."""
        chosen = [self.sets[n] for n in names]
        parts = [selected_features(read_features(spark, s.path), images, fields if s.by_field else None) for s in chosen]
        features = combined_features(parts, ["image_ix", "prf_ix"], [not s.by_field for s in chosen])
        return features.select("prf_ix", "image_ix", "f"), combined_versions({s.name: s.groups for s in chosen}, solo)

    @classmethod
    def from_table(cls, sets: DataFrame, most: int = 10_000) -> FeatureSets:
        """The sets of a table (name, path, by_field, groups array<struct<name,width>>), groups in order."""
        rows = sets.select("name", "path", "by_field", "groups").orderBy("name").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many sets")
        return cls(*[FeatureSet(r["name"], r["path"], {g[0]: g[1] for g in r["groups"] or []}, r["by_field"]) for r in rows])

    def named(self, types: str) -> list[str]:
        """The sets of a comma-joined list of types, in order and each once; a type ends in * for all sets that begin so."""
        out: list[str] = []
        for kind in filter(None, (k.strip() for k in types.split(","))):
            found = sorted(n for n in self.sets if n.startswith(kind[:-1])) if kind.endswith("*") else [kind] if kind in self.sets else []
            if not found:
                raise ValueError(f"no feature set is named {kind}; there are {', '.join(sorted(self.sets))}")
            out += [n for n in found if n not in out]
        return out
