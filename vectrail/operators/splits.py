"""Train / validation / test memberships as a long table (split, unit, part).

Order within a split comes from md5(seed | unit), so a split is the same on any
cluster and can be repeated in SQL.  Part sizes use half-even rounding.  Rows the
rules leave over carry the part 'unused'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.labels import is_combination, normalize_label
from vectrail.operators.relational import dominant_label, grouped_rank
from vectrail.operators.vectors import diagnostics
from vectrail.tables import group_key

TEST_SHARE, VALIDATION_SHARE, LABEL_SHARE = 0.15, 0.1765, 0.20


class Unsupported(ValueError):
    """A split that the data can't give; callers record it with its reason."""


def hash_order(seed: int | Column, unit: str) -> Column:
    return F.md5(F.concat_ws("|", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), F.col(unit).cast("string")))


def _key(keys: list[str]) -> Column:
    return group_key(*keys) if keys else F.lit(0).cast("long")


def _sizes(n: Column) -> tuple[Column, Column]:
    test = F.least(n - 2, F.greatest(F.lit(1), F.bround(n * TEST_SHARE))).cast("long")
    rest = n - test
    validation = F.least(rest - 1, F.greatest(F.lit(1), F.bround(rest * VALIDATION_SHARE))).cast("long")
    return test, validation


def random_part(df: DataFrame, unit: str, seed: int | Column, stratum: str | None = None, among: list[str] | None = None) -> DataFrame:
    """Adds ``part``: a random split within each stratum, separately for each value of ``among``.

    Strata are few and large, so units are ranked in ranges, never a stratum in one task, and by their keys
    alone: other columns stay where they are.  Repeated rows of a unit take one part.  A ``seed`` column must
    be one of ``among``.
    """
    keys = [*(among or []), *([stratum] if stratum else [])]
    narrow = df.select(_key(keys).alias("_k"), *([seed.alias("_s")] if isinstance(seed, Column) else []), unit).distinct()
    ranked = grouped_rank(narrow, ["_k"], [hash_order(F.col("_s") if isinstance(seed, Column) else seed, unit), F.col(unit)], "_rn")
    sizes = narrow.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    n, rn = F.col("_n"), F.col("_rn")
    test, validation = _sizes(n)
    part = F.when(n < 3, F.lit("train")).when(rn <= test, F.lit("test")).when(rn <= test + validation, F.lit("validation")).otherwise(F.lit("train"))
    placed = ranked.join(sizes, "_k").select(F.col("_k").alias("_pk"), F.col(unit).alias("_pu"), part.alias("part"))
    there = df.withColumn("_k", _key(keys))
    return there.join(placed, (there["_k"] == placed["_pk"]) & there[unit].eqNullSafe(placed["_pu"])).drop("_k", "_pk", "_pu")


def remaining_parts(df: DataFrame, unit: str, seed: int | Column, held: Column, among: list[str] | None = None, stratum: str | None = None) -> DataFrame:
    """``held`` rows are the test part; the rest goes to train and validation, its own test share to 'unused'."""
    flagged = df.withColumn("_held", F.coalesce(held, F.lit(False)))
    parts = random_part(flagged, unit, seed, stratum, [*(among or []), "_held"])
    part = F.when(F.col("_held"), F.lit("test")).when(F.col("part") == "test", F.lit("unused")).otherwise(F.col("part"))
    return parts.withColumn("part", part).drop("_held")


def held_labels(df: DataFrame, label: str, seed: int | Column, eligible: Column, among: list[str]) -> DataFrame:
    """(among, label) of the labels held out: a fifth of the eligible ones, one at least, one fewer than all at most."""
    labels = df.where(eligible & F.col(label).isNotNull()).select(*among, label).distinct()
    ranked = grouped_rank(labels, among, [hash_order(seed, label), F.col(label)], "_rn").withColumn("_k", _key(among))
    sizes = labels.groupBy(_key(among).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    take = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * LABEL_SHARE)))
    return ranked.join(sizes, "_k").where((n >= 2) & (F.col("_rn") <= take)).select(*among, label)


def unseen_label_parts(
    df: DataFrame, unit: str, label: str, seed: int, control: str = "is_control", among: list[str] | None = None, with_controls: bool = False
) -> DataFrame:
    """Test part: the rows of held-out labels, controls only if ``with_controls``.

    With a label of cell state or lineage this is the split of an unseen state or lineage, whose controls are held out, too.
    """
    among = among or []
    clean = df.withColumn("_label", normalize_label(label))
    held = held_labels(clean, "_label", seed + 2000, ~F.col(control), among).withColumn("_hit", F.lit(True))
    joined = clean.join(held, [*among, "_label"], "left")
    hit = F.col("_hit") if with_controls else F.col("_hit") & ~F.col(control)
    return remaining_parts(joined, unit, seed, hit, among, control).drop("_label", "_hit")


def combination_parts(df: DataFrame, unit: str, label: str, seed: int, control: str = "is_control", among: list[str] | None = None) -> DataFrame:
    """Test part: the non-control rows whose label names a combination."""
    return remaining_parts(df, unit, seed + 3000, is_combination(label) & ~F.col(control), among, control)


def low_support_cutoff(df: DataFrame, support: str, among: list[str], unit: str) -> DataFrame:
    """(among, cutoff): the support at sorted position round(0.2 n), counted from one."""
    sizes = df.groupBy(*among).agg(F.greatest(F.lit(1).cast("long"), F.bround(F.count(F.lit(1)) * LABEL_SHARE).cast("long")).alias("_at"))
    ranked = grouped_rank(df.select(*among, support, unit), among, [F.col(support), F.col(unit)], "_rn")
    joined = ranked.join(sizes, among) if among else ranked.join(F.broadcast(sizes))  # one row without groups
    return joined.where("_rn = _at").select(*among, F.col(support).alias("cutoff"))


def low_support_parts(df: DataFrame, unit: str, support: str, seed: int, among: list[str], control: str = "is_control") -> DataFrame:
    """Test part: rows whose support is at most the cutoff, ties included."""
    cut_at = low_support_cutoff(df.where(~F.col(control)), support, among, unit)
    joined = df.join(F.broadcast(cut_at) if not among else cut_at, among, "left")
    return remaining_parts(joined, unit, seed + 3000, (F.col(support) <= F.col("cutoff")) & ~F.col(control), among, control).drop("cutoff")


def dataset_parts(df: DataFrame, unit: str, dataset: str, held: str, seed: int, control: str = "is_control") -> DataFrame:
    """Test part: all rows of one dataset, over the union of all."""
    return remaining_parts(df, unit, seed + 3000, F.col(dataset) == held, None, control)


def external_target(catalog: DataFrame) -> str:
    """The first dataset set aside for external validation and ready for it."""
    row = (
        catalog.where("external_validation_ready AND split_role LIKE 'external%'")
        .orderBy("dataset_id")
        .select("dataset_id")
        .first()
    )
    if row is None:
        raise Unsupported("no dataset is ready for external validation")
    return row[0]


def state_labels(df: DataFrame, group: str, candidates: list[str], least: float = 0.8, kinds: int = 2, groups: int = 8) -> tuple[DataFrame, str]:
    """Dominant, pure labels of groups from the first candidate column that gives enough of them."""
    for c in candidates:
        if c not in df.columns:
            continue
        found = dominant_label(df.withColumn(c, normalize_label(c)), group, c, least)
        row = found.agg(F.countDistinct(c), F.count(F.lit(1))).first()
        if row[0] >= kinds and row[1] >= groups:
            return found.withColumnRenamed(c, "label"), c
    raise Unsupported("no label column gives enough pure groups")


def part_counts(members: DataFrame, keys: list[str], label: str, reference: str, control: str = "is_control") -> DataFrame:
    """Per split and part: units, distinct labels and references, controls, combinations; one aggregate."""
    return members.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.countDistinct(F.when(~F.col(control), F.col(label))).alias("n_perturbations"),
        F.countDistinct(reference).alias("n_reference_keys"),
        F.count_if(F.col(control)).alias("n_controls"),
        F.count_if(is_combination(label) & ~F.col(control)).alias("n_combinations"),
    )


def overlap_counts(members: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): distinct non-null values that stand in both the train and the test part."""
    flags = members.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.bool_or(F.col("part") == "train").alias("a"), F.bool_or(F.col("part") == "test").alias("b")
    )
    return flags.groupBy(*keys).agg(F.count_if(F.col("a") & F.col("b")).alias(name))


def audit(members: DataFrame, keys: list[str], label: str, reference: str, vector: str, control: str = "is_control") -> DataFrame:
    """One row a split: part sizes, overlaps between train and test, distance of their centroids."""
    from vectrail.operators.vectors import centroid_distance

    sizes = members.groupBy(*keys).agg(*[F.count_if(F.col("part") == p).alias(f"{p}_units") for p in ("train", "validation", "test", "unused")])
    labels = overlap_counts(members.where(~F.col(control)), keys, label, "perturbation_overlap_train_test")
    refs = overlap_counts(members, keys, reference, "reference_key_overlap_train_test")
    features = members.where(F.size(vector) > 0).select(*keys, "part", *diagnostics(vector))
    apart = centroid_distance(features, keys, "part", ["vec_mean", "vec_abs_mean", "vec_std", "vec_l2", "vec_max_abs"])
    return sizes.join(labels, keys, "left").join(refs, keys, "left").join(apart, keys, "left")


def record(split_family: str, track: str, scope: str, seed: int, held: str = "", reason: str = "") -> dict[str, object]:
    """A row of the split registry; a reason marks an unsupported split."""
    stem = "__".join(x for x in (split_family, scope, f"holdout-{held}" if held else "", f"seed{seed}", track) if x).replace("/", "_")
    return {
        "split_id": stem, "split_family": split_family, "track": track, "dataset_scope": scope, "seed": seed,
        "heldout_target": held, "status": "unsupported" if reason else "ready", "unsupported_reason": reason,
    }
