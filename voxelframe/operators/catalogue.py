"""Fixed dictionaries of feature columns and groups, and column masks of combined models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Texture statistics by group (name, number of columns, simple group), 641 columns in all.
TEXTURE_GROUPS = (
    ("pixel_stats", 6, "pixel"),
    ("mean_magnitudes", 16, "energy-mean"),
    ("mean_realparts", 16, "linear-mean"),
    ("marginal_stats_lowpass_recons", 10, "marginal"),
    ("variance_highpass_resid", 1, "marginal"),
    ("magnitude_feature_autocorrs", 272, "energy-auto"),
    ("lowpass_recon_autocorrs", 73, "linear-auto"),
    ("highpass_resid_autocorrs", 25, "linear-auto"),
    ("magnitude_within_scale_crosscorrs", 24, "energy-cross-orient"),
    ("real_within_scale_crosscorrs", 24, "linear-cross-orient"),
    ("magnitude_across_scale_crosscorrs", 48, "energy-cross-scale"),
    ("real_imag_across_scale_crosscorrs", 96, "linear-cross-scale"),
    ("real_spatshift_within_scale_crosscorrs", 10, "linear-cross-orient"),
    ("real_spatshift_across_scale_crosscorrs", 20, "linear-cross-scale"),
)
#: The first columns, of the first five groups, are low-level.
LOW_LEVEL = 49
SIMPLE = ("pixel", "energy-mean", "linear-mean", "marginal", "energy-auto", "linear-auto", "energy-cross-orient", "linear-cross-orient", "energy-cross-scale", "linear-cross-scale")
# Contour clusters that show two lines, a junction, or something else; the rest are single lines.
DOUBLE_LINES = (17, 27, 30, 32, 33, 34, 35, 40, 51, 59, 60, 61, 64, 65, 66, 68, 69, 73, 75, 78, 80, 84, 88, 90, 96, 106, 108, 110, 111, 113, 114, 132, 133, 134, 136)
JUNCTIONS = (38, 62, 63, 67, 70, 77, 79, 81, 86, 94, 100, 102, 103, 112, 115, 116, 118, 119, 120, 124, 125, 126, 137, 138, 140, 142, 143, 144, 145, 146, 149)
OTHER_CLUSTERS = (107,)


def texture_columns(spark: SparkSession) -> DataFrame:
    """(column, group_ix, group_name, simple_ix, simple_name, low_level) of the texture statistics."""
    rows = [(k, name, n, SIMPLE.index(simple), simple) for k, (name, n, simple) in enumerate(TEXTURE_GROUPS)]
    groups = spark.createDataFrame(rows, "group_ix int, group_name string, n int, simple_ix int, simple_name string")
    each = groups.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    number = (F.row_number().over(Window.orderBy("group_ix", "k")) - 1).alias("column")
    return each.select(number, "group_ix", "group_name", "simple_ix", "simple_name").withColumn("low_level", F.col("column") < LOW_LEVEL)


def texture_labels(scales: int = 4, orientations: int = 4) -> list[tuple[str, int | None, int | None, int | None]]:
    """(group, scale, orientation, other orientation or shift) of each texture column in order; scales from coarse to fine, null for residuals and pixels."""
    from itertools import combinations, product

    from .kernels import AUTO_SIZES, SHIFTS

    auto = [(size * size + 1) // 2 for size in AUTO_SIZES[-(scales + 1) :]]
    levels, pairs, shifts = [None, *range(scales)], list(combinations(range(orientations), 2)), range(len(SHIFTS))
    each = list(product(range(scales), range(orientations)))
    across = [(s, a, b) for s in range(1, scales) for a, b in product(range(orientations), repeat=2)]
    places = {
        "pixel_stats": [(None, None, None)] * 6,
        "mean_magnitudes": [(s, o, None) for s, o in each],
        "mean_realparts": [(s, o, None) for s, o in each],
        "marginal_stats_lowpass_recons": [(s, None, None) for s in levels for _ in range(2)],
        "variance_highpass_resid": [(None, None, None)],
        "magnitude_feature_autocorrs": [(s, o, None) for s, o in each for _ in range(auto[s + 1])],
        "lowpass_recon_autocorrs": [(s, None, None) for s, n in zip(levels, auto, strict=True) for _ in range(n)],
        "highpass_resid_autocorrs": [(None, None, None)] * auto[-1],
        "magnitude_within_scale_crosscorrs": [(s, a, b) for s in range(scales) for a, b in pairs],
        "real_within_scale_crosscorrs": [(s, a, b) for s in range(scales) for a, b in pairs],
        "magnitude_across_scale_crosscorrs": across,
        "real_imag_across_scale_crosscorrs": [(s, a, b) for s in range(1, scales) for _ in ("real", "imaginary") for a, b in product(range(orientations), repeat=2)],
        "real_spatshift_within_scale_crosscorrs": [(0, a, b) for a, b in combinations(shifts, 2)],
        "real_spatshift_across_scale_crosscorrs": [(0, o, k) for o, k in product(range(orientations), shifts)],
    }
    return [(name, *place) for name, _, _ in TEXTURE_GROUPS for place in places[name]]


def component_groups(names: Column) -> Column:
    """Number of the simple group of a component, from the name of the texture group (or of one of its scales) that it was fitted on."""
    out = F.lit(None).cast("int")
    for name, _, simple in TEXTURE_GROUPS:
        out = F.when(F.contains(names, F.lit(name)), SIMPLE.index(simple)).otherwise(out)
    return out


def scale_groups(columns: DataFrame, kind: str, scale: str) -> DataFrame:
    """A dense number for each (kind, scale) pair, in order; numbered over the distinct pairs."""
    pairs = columns.select(kind, scale).distinct().withColumn("pair_ix", F.dense_rank().over(Window.orderBy(kind, scale)) - 1)
    return columns.join(pairs, [kind, scale])


def cluster_groups(cluster: Column) -> list[Column]:
    """(double, junction, single, other) flags of a contour cluster."""
    double, junction, other = cluster.isin(*DOUBLE_LINES), cluster.isin(*JUNCTIONS), cluster.isin(*OTHER_CLUSTERS)
    return [double, junction, ~double & ~junction & ~other, other]


#: Versions of a combined model: name, needed (modules, subsets of the module; None for any number), and the test that
#: its columns pass: whether they are of the version's module, and whether they are in its subset of the module's groups.
_VERSIONS = (
    ("full_combined", lambda n, k: True, lambda own, inside: True),
    ("just_{module}", lambda n, k: True, lambda own, inside: own),
    ("leave_out_{module}", lambda n, k: n > 2, lambda own, inside: not own),
    ("{module}_{subset}_no_other_modules", lambda n, k: k > 0, lambda own, inside: own and inside),
    ("{module}_{subset}_plus_other_modules", lambda n, k: k == 2, lambda own, inside: not own or inside),
)


def combined_versions(modules: dict[str, dict[str, int]], solo: bool = True) -> dict[str, list[int]]:
    """Column masks of modules joined side by side, by the rules of _VERSIONS; a module is its groups' widths by name.

    Without solo no module stands alone, and each is left out however many there are.
    """
    from .models import partial_versions

    columns = [(module, group) for module, groups in modules.items() for group, n in groups.items() for _ in range(n)]
    subsets = {module: {name: set(used) for name, used in partial_versions({g: [g] for g in groups}).items() if name != "full"} for module, groups in modules.items()}
    out = {}
    for pattern, applies, keeps in _VERSIONS:
        for module in modules:
            if "just_{" in pattern and not solo or not (applies(len(modules), len(subsets[module])) or "leave_out" in pattern and not solo):
                continue
            for name, groups in subsets[module].items() if "{subset}" in pattern else [("", set())]:
                out[pattern.format(module=module, subset=name)] = [k for k, (m, g) in enumerate(columns) if keeps(m == module, g in groups)]
    return out


def combined_features(parts: list[DataFrame], by: list[str], everywhere: list[bool] | None = None, field: str = "prf_ix") -> DataFrame:
    """Feature arrays f of several sets side by side; a set that is one whole-image field goes to every field."""
    everywhere = everywhere or [False] * len(parts)
    out = None
    for k, (df, whole) in enumerate(zip(parts, everywhere, strict=True)):
        keys = [b for b in by if b != field] if whole else by
        one = df.select(*keys, F.col("f").alias(f"f{k}"))
        out = one if out is None else out.join(one, [c for c in keys if c in out.columns])
    return out.select(*by, F.concat(*[f"f{k}" for k in range(len(parts))]).alias("f"))


def complete_fields(sets: DataFrame, field: str, split: str, splits: list[str]) -> DataFrame:
    """Rows of the fields that have rows in every split."""
    have = sets.groupBy(field).agg(F.size(F.collect_set(split)).alias("k")).where(F.col("k") == len(splits))
    return sets.join(have.select(field), field, "left_semi")


def voxel_groups(scores: DataFrame, key: str, category: str, value: str, excluded: DataFrame, k: int) -> DataFrame:
    """The k keys of largest positive value for each category, without the excluded keys."""
    from .ranking import top

    free = scores.join(excluded.select(key).distinct(), key, "left_anti").where(F.col(value) > 0)
    return top(free, [category], F.col(value), key, k)
