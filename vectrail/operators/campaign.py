"""From catalog to run table: split grids, run matrices, example sets, status and contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.labels import is_combination, normalize_label
from vectrail.operators import splits
from vectrail.operators.reliability import support_features, targets

FAMILIES = ["random_split", "unseen_perturbation_split", "unseen_combination_split", "low_support_split", "unseen_cell_state_split", "unseen_cell_type_or_lineage_split"]


def split_grid(
    units: DataFrame, seeds: list[int], scope: str = "dataset_id", state: str | None = None, lineage: str | None = None, external: str | None = None,
    families: list[str] | None = None,
) -> DataFrame:
    """(split_id, split_family, scope, seed, heldout_target, signature_id, part) of every family, scope and seed.

    ``units``: (signature_id, scope, perturbation_label, is_control, n_cells, and the label columns ``state`` and
    ``lineage`` where there are any).  Each dataset is split by itself in the families of one dataset; each in turn
    is held out from all others in ``dataset_heldout_split``, and ``external`` in ``external_holdout``.  All splits
    are flagged first and then ranked together, so the grid is as many jobs as one split.
    """
    every = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("_seed")
    seeded = units.select("*", every)
    among = [scope, "_seed"]
    plain = ~F.col("is_control")

    def named(family: str, rows: DataFrame, held: Column, order: int, scope_name: Column, target: Column | None = None) -> DataFrame:
        target = target if target is not None else F.lit("")
        stem = F.concat_ws("__", F.lit(family), scope_name, F.when(target != "", F.concat(F.lit("holdout-"), target)), F.concat(F.lit("seed"), F.col("_seed")))
        return rows.select(
            stem.alias("split_id"), F.lit(family).alias("split_family"), scope_name.alias("scope"), F.col("_seed").alias("seed"), target.alias("heldout_target"),
            "signature_id", "is_control", (F.col("_seed") + order).alias("_order"), F.coalesce(held, F.lit(False)).alias("_held"),
        )

    def by_label(family: str, label: str, with_controls: bool) -> DataFrame:
        clean = seeded.withColumn("_label", normalize_label(label))
        hit = splits.held_labels(clean, "_label", F.col("_seed") + 2000, plain, among).withColumn("_hit", F.lit(True))
        held = F.col("_hit") if with_controls else F.col("_hit") & plain
        return named(family, clean.join(hit, [*among, "_label"], "left"), held, 0, F.col(scope))

    def low() -> DataFrame:
        at = splits.low_support_cutoff(units.where(plain), "n_cells", [scope], "signature_id")
        return named("low_support_split", seeded.join(at, scope, "left"), (F.col("n_cells") <= F.col("cutoff")) & plain, 3000, F.col(scope))

    def whole(family: str, scope_name: str, held: DataFrame) -> DataFrame:
        pairs = seeded.join(held, F.lit(True))  # as many copies of the units as there are datasets to hold out: the grid itself
        return named(family, pairs, F.col(scope) == F.col("_target"), 3000, F.lit(scope_name), F.col("_target"))

    make = {
        "random_split": lambda: named("random_split", seeded, F.lit(False), 0, F.col(scope)),
        "unseen_perturbation_split": lambda: by_label("unseen_perturbation_split", "perturbation_label", False),
        "unseen_combination_split": lambda: named("unseen_combination_split", seeded, is_combination("perturbation_label") & plain, 3000, F.col(scope)),
        "low_support_split": low,
        "unseen_cell_state_split": lambda: by_label("unseen_cell_state_split", state, True) if state else None,
        "unseen_cell_type_or_lineage_split": lambda: by_label("unseen_cell_type_or_lineage_split", lineage, True) if lineage else None,
        "dataset_heldout_split": lambda: whole("dataset_heldout_split", "all_datasets", units.select(F.col(scope).alias("_target")).where("_target IS NOT NULL").distinct()),
        "external_holdout": lambda: whole("external_holdout", "internal_vs_external", units.sparkSession.createDataFrame([(external,)], "_target string")) if external else None,
    }
    flagged = reduce(DataFrame.unionByName, [f for f in (make[x]() for x in families or make) if f is not None])
    parts = splits.random_part(flagged, "signature_id", F.col("_order"), "is_control", ["split_id", "_held"])
    part = F.when(F.col("split_family") == "random_split", F.col("part")).when(F.col("_held"), "test").when(F.col("part") == "test", "unused").otherwise(F.col("part"))
    return parts.withColumn("part", part).drop("is_control", "_order", "_held")


def split_records(grid: DataFrame, asked: DataFrame) -> DataFrame:
    """(split_id, split_family, scope, seed, heldout_target, status, reason, n_train, n_validation, n_test) of every split asked for.

    ``asked``: (split_id, split_family, scope, seed, heldout_target).  A split that isn't in the grid, or holds out no row
    or every row, is unsupported, with its reason.
    """
    sizes = grid.groupBy("split_id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validation", "test")])
    n = lambda p: F.coalesce(F.col(f"n_{p}"), F.lit(0).cast("long"))
    reason = F.when(F.col("n_test").isNull(), "no rows or no labels to hold out").when(n("test") == 0, "test mask selects no rows").when(n("train") == 0, "test mask selects all rows").otherwise("")
    return asked.join(sizes, "split_id", "left").select(
        *asked.columns, F.when(reason == "", "ready").otherwise("unsupported").alias("status"), reason.alias("reason"), *[n(p).alias(f"n_{p}") for p in ("train", "validation", "test")]
    )


def supported(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, reason): whether a split has rows in both its train and its test part."""
    sizes = parts.groupBy(*keys).agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b"))
    reason = F.when(F.col("b") == 0, "no test rows").when(F.col("a") == 0, "no train rows").otherwise("")
    return sizes.select(*keys, F.when(reason == "", "ready").otherwise("unsupported").alias("status"), reason.alias("reason"))


def contract(df: DataFrame, truth: str, guess: str, expected: str) -> DataFrame:
    """(run_id, rows, bad_shape, bad_count): rows whose vectors are unlike each other or unlike the declared length."""
    return df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(truth).isNotNull() | ~F.col(guess).isNotNull() | (F.size(truth) != F.size(guess))).alias("bad_shape"),
        F.count_if(F.col(expected).isNotNull() & (F.size(truth) != F.col(expected))).alias("bad_count"),
    )


def build_examples(cases: DataFrame, units: DataFrame, run_context: DataFrame, families: list[str], threshold: str) -> DataFrame:
    """Labelled stress cases with their run's context and what their label, reference and dataset have in train.

    ``cases`` carries run_id, signature_id and split_id; ``run_context`` is one row a run.
    """
    kept = targets(cases.where(F.col("split_family").isin(families)), threshold)
    features = support_features(units)
    drop = [c for c in features.columns if c in kept.columns and c not in ("split_id", "signature_id")]
    once = features.drop(*drop)
    once = once.groupBy("split_id", "signature_id").agg(*[F.max(c).alias(c) for c in once.columns if c not in ("split_id", "signature_id")])  # a signature placed twice
    extra = run_context.drop(*[c for c in run_context.columns if c in kept.columns and c != "run_id"])
    return kept.join(once, ["split_id", "signature_id"], "left").join(extra, "run_id", "left")


def artifact_status(runs: DataFrame, metrics: DataFrame, failures: DataFrame) -> DataFrame:
    """(run_id, status): success where metrics exist, failed where only a failure does, else missing."""
    m, f = (d.select("run_id").distinct().withColumn(n, F.lit(True)) for d, n in ((metrics, "_m"), (failures, "_f")))
    status = F.when(F.col("_m"), "success").when(F.col("_f"), "failed").otherwise("missing")
    return runs.join(m, "run_id", "left").join(f, "run_id", "left").withColumn("artifact_status", status).drop("_m", "_f")


def retained_contrast(df: DataFrame, decision: str, columns: list[str]) -> DataFrame:
    """Count, mean and sample deviation of each column for kept and rejected rows."""
    return df.groupBy(decision).agg(
        F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))]
    )


def schedule(df: DataFrame, costs: dict[str, dict[str, int]], tie: str) -> list[Column]:
    """Order by the cost of each column's value, unknown values last."""
    out = []
    for column, cost in costs.items():
        rank = F.lit(len(cost) + 1)
        for value, n in cost.items():
            rank = F.when(F.col(column) == value, F.lit(n)).otherwise(rank)
        out.append(rank)
    return [*out, F.col(tie)]


def safe_float(text: str | Column) -> Column:
    x = (F.col(text) if isinstance(text, str) else text).try_cast("double")
    return F.when(~F.isnan(x), x)


def first_label_column(df: DataFrame, candidates: list[str], kinds: int = 2) -> str | None:
    """The first candidate column with enough distinct labels; one aggregate over those present."""
    from vectrail.functions.labels import normalize_label

    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.countDistinct(normalize_label(c)).alias(c) for c in present]).first()
    return next((c for c in present if row[c] >= kinds), None)


def existing_columns(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[list[str], list[str]]:
    """Those of the wanted columns that ``df`` has with a fitting type."""
    kinds = dict(df.dtypes)
    is_number = lambda c: kinds[c].startswith(("double", "float", "decimal", "tinyint", "smallint", "int", "bigint", "boolean"))
    return [c for c in numeric if c in kinds and is_number(c)], [c for c in categorical if c in kinds and not is_number(c)]


RUN_SPEC = {
    "run_id": "string", "model": "string", "split_json_path": "string", "split_family": "string", "dataset_scope": "string", "seed": "int",
    "heldout_target": "string", "gene_space_policy": "string", "expected_gene_count": "int", "output_dir": "string", "log_file": "string",
}


def run_specs(runs: DataFrame) -> DataFrame:
    """Manifest rows under one schema; a missing held-out target is '', a missing gene count 0."""
    defaults = {"heldout_target": F.lit(""), "expected_gene_count": F.lit(0)}
    at = lambda c: F.col(c) if c in runs.columns else F.lit(None)
    return runs.select(*[F.coalesce(at(c).cast(t), defaults[c].cast(t)).alias(c) if c in defaults else at(c).cast(t).alias(c) for c, t in RUN_SPEC.items()])


def materialise(grid: DataFrame, signatures: DataFrame, spaces: DataFrame, vector: str, dataset: str = "dataset_id") -> DataFrame:
    """(split_id, split_family, signature_id, part, vector): split rows with their vectors in the split's gene space.

    Splits that mix datasets take the positions every dataset has, others the dataset's own; ``spaces`` is (dataset, pos).
    Positions are kept in order, one short list a dataset, so vectors are cut where they stand.
    """
    n = spaces.select(dataset).distinct().count()
    shared = spaces.groupBy("pos").agg(F.countDistinct(dataset).alias("_n")).where(F.col("_n") == n).agg(F.array_sort(F.collect_list("pos")).alias("p")).first()["p"]  # one gene space
    own = spaces.groupBy(dataset).agg(F.array_sort(F.collect_set("pos")).alias("_own"))
    rows = grid.select("split_id", "split_family", "signature_id", "part").join(signatures, "signature_id").join(own, dataset, "left")
    mixed = F.col("split_family").isin("dataset_heldout_split", "external_holdout")
    keep = F.when(mixed, F.array(*[F.lit(int(p)) for p in shared or []]).cast("array<int>")).otherwise(F.col("_own").cast("array<int>"))
    short = F.array_max(keep) >= F.size(vector)
    cut_down = F.when(short, F.raise_error(F.lit("a vector lacks positions of its gene space")).cast("array<double>")).otherwise(F.transform(keep, lambda i: F.get(F.col(vector), i)))
    return rows.select("split_id", "split_family", "signature_id", "part", cut_down.alias("vector"))
