"""Evaluation of runs: selection, anchors, labels, selective metrics, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.operators.kernels import rank_tests
from vectrail.operators.vectors import cosine, pathway_fidelity, retrieval
from vectrail.session import scratch
from vectrail.operators.relational import grouped_quantiles, benjamini_hochberg, clip, first_per, min_rank, trapezoid
from vectrail.operators.vectors import EPS

# The families that count as stress, those anchored at their held-out dataset, and statuses that count.
STRESS_FAMILIES = ["unseen_perturbation_split", "unseen_combination_split", "low_support_split", "dataset_heldout_split", "external_holdout"]
HELD_FAMILIES = ["dataset_heldout_split", "external_holdout"]
GOOD_STATUS = ["success", "cached"]
TAUS = [i / 10 for i in range(1, 11)]
Z = 1.959964
ANCHOR_SHARE = 0.8


def latest_status(registry: DataFrame, run: str, at: str, tie: str | None = None) -> DataFrame:
    """The newest row of each run in an append-only registry."""
    order = [F.col(at).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return first_per(registry, [run], order)


def select_runs(manifest: DataFrame, registry: DataFrame, run: str, at: str, tie: str | None = None) -> DataFrame:
    """(run, status, selected, note): manifest runs with their newest status, then registry runs the manifest lacks."""
    newest = latest_status(registry, run, at, tie).select(run, "status")
    known = manifest.select(run).distinct()
    inside = known.join(newest, run, "left").withColumn("selected", F.coalesce(F.col("status").isin(GOOD_STATUS), F.lit(False)))
    inside = inside.withColumn("note", F.when(F.col("status").isNull(), "missing_in_registry").when(F.col("selected"), "selected").otherwise("not_successful"))
    extra = newest.join(known, run, "left_anti").withColumn("selected", F.lit(False)).withColumn("note", F.lit("not_in_manifest_smoke_or_extra"))
    return inside.unionByName(extra)


def anchor_dataset(family: str, scope: str, held: str) -> Column:
    """The dataset a run is anchored at: the held-out one for dataset-level families."""
    return F.when(F.col(family).isin(HELD_FAMILIES), F.col(held)).otherwise(F.col(scope))


def anchors(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, anchor_mean, anchor_median): cosines of the random run of the same model, dataset and seed."""
    random = first_per(
        runs.where("split_family = 'random_split'").select("model", F.col("dataset_scope").alias("anchor"), "seed", F.col("run_id").alias("anchor_run")),
        ["model", "anchor", "seed"], [F.col("anchor_run")],
    )
    mine = cases.join(random.select(F.col("anchor_run").alias("run_id")), "run_id", "left_semi").select("run_id", "cosine_similarity")
    median = grouped_quantiles(mine, ["run_id"], "cosine_similarity", [0.5]).select(F.col("run_id").alias("anchor_run"), F.col("quantile").alias("anchor_median"))
    per = mine.groupBy(F.col("run_id").alias("anchor_run")).agg(F.avg("cosine_similarity").alias("anchor_mean")).join(median, "anchor_run", "left")
    wanted = runs.select("run_id", "model", "seed", anchor_dataset("split_family", "dataset_scope", "heldout_target").alias("anchor"))
    return wanted.join(random.join(per, "anchor_run", "left"), ["model", "anchor", "seed"], "left").select("run_id", "anchor_mean", "anchor_median")


def transportable(cosine: str, anchor: str, family: str, control: Column, share: float = ANCHOR_SHARE) -> Column:
    """Whether a stress prediction holds up against its anchor; null where that isn't asked."""
    asked = ~control & F.col(family).isin(STRESS_FAMILIES) & F.col(anchor).isNotNull() & F.col(cosine).isNotNull()
    return F.when(asked, F.col(cosine) >= F.lit(share) * F.col(anchor))


def drop_and_retention(mean: str, anchor: str) -> list[Column]:
    return [
        (F.col(anchor) - F.col(mean)).alias("random_to_stress_drop"),
        F.when(F.col(anchor).isNotNull(), F.col(mean) / F.greatest(F.col(anchor), F.lit(EPS))).alias("stress_retention"),
    ]


def selective_table(cases: DataFrame, keys: list[str], taus: list[float] = TAUS) -> DataFrame:
    """(keys, tau, n, accepted, coverage, selective_risk, abstention_gain, false_rate, known): a long threshold grid.

    One aggregate with a pair of conditional sums per threshold; rows are not multiplied by the grid.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("risk").alias("base_risk")]
    for i, t in enumerate(taus):
        ok = F.col("confidence") >= t
        aggs += [
            F.count_if(ok).alias(f"a{i}"), F.avg(F.when(ok, F.col("risk"))).alias(f"r{i}"),
            F.count_if(ok & F.col("transportable").isNotNull()).alias(f"k{i}"), F.count_if(ok & ~F.col("transportable")).alias(f"f{i}"),
        ]
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"a{i}").alias("accepted"), F.col(f"r{i}").alias("selective_risk"), F.col(f"k{i}").alias("known"), F.col(f"f{i}").alias("n_false")) for i, t in enumerate(taus)]))
    return cases.groupBy(*keys).agg(*aggs).select(*keys, "n", "base_risk", grid.alias("g")).select(
        *keys, "g.tau", "n", "base_risk", "g.accepted", (F.col("g.accepted") / F.col("n")).alias("coverage"), "g.selective_risk",
        (F.col("base_risk") - F.col("g.selective_risk")).alias("abstention_gain"), "g.known", "g.n_false",
        F.try_divide(F.col("g.n_false"), F.col("g.known")).alias("false_transportability_rate"),
    )


def selective_areas(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area_under_selective_risk_curve): risk over coverage, the full-coverage point added, empty points at base risk."""
    points = table.select(*keys, F.col("tau").alias("t"), "coverage", F.coalesce("selective_risk", "base_risk").alias("risk"))
    full = table.groupBy(*keys).agg(F.first("base_risk").alias("risk")).select(*keys, F.lit(0.0).alias("t"), F.lit(1.0).alias("coverage"), "risk")
    return trapezoid(points.unionByName(full), keys, "coverage", "risk", "t", "area_under_selective_risk_curve")


def coverage_area(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area_under_coverage_curve): sorted coverages over an even grid from 0 to 1."""
    cov = F.array_sort(F.array_append(F.collect_list("coverage"), F.lit(1.0)))  # one entry a threshold
    got = table.groupBy(*keys).agg(cov.alias("c"))
    inner = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) - (F.element_at("c", 1) + F.element_at("c", -1)) / 2
    return got.select(*keys, (inner / (F.size("c") - 1)).alias("area_under_coverage_curve"))


def wilson(count: str, total: str, prefix: str) -> list[Column]:
    """Lower and upper end of the 95 % Wilson interval of a proportion; null without trials."""
    n = F.when(F.col(total) > 0, F.col(total).cast("double"))
    p = F.col(count) / n
    z2 = Z * Z
    mid, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    return [clip((mid + s * half) / (1 + z2 / n), 0.0, 1.0).alias(f"{prefix}_{e}") for s, e in ((-1, "low"), (1, "high"))]


def family_summary(metrics: DataFrame, columns: list[str], keys: tuple[str, ...] = ("model", "split_family")) -> DataFrame:
    """Runs, mean and median of the first column, means of the others, per model and family; null keys are kept."""
    first = columns[0]
    flat = metrics.groupBy(*keys).agg(F.count("run_id").alias("n_runs"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    median = grouped_quantiles(metrics, list(keys), first, [0.5]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("quantile").alias(f"median_{first}"))
    joined = flat.join(median, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.select(*keys, "n_runs", f"mean_{first}", f"median_{first}", *[f"mean_{c}" for c in columns[1:]])


def model_pairs(metrics: DataFrame, value: str, context: list[str]) -> DataFrame:
    """(context, model_a, model_b, diff) for models a < b that share a context; several runs are averaged first.

    Contexts with a null key match nothing.
    """
    kept = metrics.where(F.col(value).isNotNull())
    for c in context:
        kept = kept.where(F.col(c).isNotNull())
    mean = kept.groupBy(*context, "model").agg(F.avg(value).alias("v"))
    a, b = mean.withColumnsRenamed({"model": "model_a", "v": "va"}), mean.withColumnsRenamed({"model": "model_b", "v": "vb"})
    return a.join(b, context).where("model_a < model_b").select(*context, "model_a", "model_b", (F.col("va") - F.col("vb")).alias("diff"))


def pairwise_comparisons(metrics: DataFrame, values: list[str], context: list[str]) -> DataFrame:
    """Signed-rank tests of all model pairs and metrics, corrected together."""
    metrics = scratch(metrics.select(*context, "model", *values))
    pairs = reduce(DataFrame.unionByName, [model_pairs(metrics, v, context).withColumn("metric", F.lit(v)) for v in values])
    tests = scratch(rank_tests(pairs, ["metric", "model_a", "model_b"], "diff"))
    return benjamini_hochberg(tests, "p_value_raw", ["metric", "model_a", "model_b"]).withColumnRenamed("reject", "reject_fdr_0_05")


def rank_instability(metrics: DataFrame, value: str, context: list[str]) -> DataFrame:
    """Per model: mean, spread, best and worst rank over contexts, and how often a pair's order is reversed."""
    kept = metrics.where(F.col(value).isNotNull())
    for c in context:
        kept = kept.where(F.col(c).isNotNull())
    per = kept.groupBy(*context, "model").agg(F.avg(value).alias("v"))
    ranked = per.withColumn("rank", min_rank(context, "v"))
    stats = ranked.groupBy("model").agg(
        F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"), F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"), F.count(F.lit(1)).alias("n_contexts"),
    )
    overall = Window.orderBy("mean_rank", "model")  # one row a model
    place = F.broadcast(stats.select("model", F.row_number().over(overall).alias("place")))
    # Places within a context, ties by model, against the overall places.
    w = Window.partitionBy(*context).orderBy("rank", "model")
    here = ranked.withColumn("here", F.row_number().over(w)).join(place, "model").select(*context, "model", "here", "place")
    other = here.withColumnsRenamed({"model": "other", "here": "there", "place": "place2"})
    turned = (
        here.join(other, context)
        .where("model <> other AND signum(here - there) <> signum(place - place2)")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("reversals"))
    )
    return stats.join(turned, "model", "left").withColumn("reversals", F.coalesce("reversals", F.lit(0).cast("long")))


def metric_fallback(table_value: Column, payload: Column, name: str) -> list[Column]:
    """A metric from the table, else the document's top level, else its 'metrics' part, and where it came from."""
    top = F.get_json_object(payload, f"$.{name}").cast("double")
    nested = F.get_json_object(payload, f"$.metrics.{name}").cast("double")
    source = F.when(table_value.isNotNull(), "table").when(top.isNotNull(), "payload").when(nested.isNotNull(), "payload.metrics")
    return [F.coalesce(table_value, top, nested).alias(name), source.alias(f"{name}_source")]


def vector_risk(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``df`` with the cosine of truth and guess and the risk, its distance from 1."""
    scored = df.withColumn("cosine", cosine(truth, guess))
    return scored.withColumn("risk", 1 - F.col("cosine"))


def biology_summary(df: DataFrame, run: str, key: str, label: str, truth: str, guess: str, sets: DataFrame) -> DataFrame:
    """Per run the mean fidelity of pathway profiles and the mean retrieval of the right label."""
    df = scratch(df.select(run, key, label, truth, guess))
    fidelity = pathway_fidelity(df, [run, key], truth, guess, sets)
    found = retrieval(df, run, key, label, truth, guess)
    columns = ("pathway_cosine", "pathway_direction", "top1", "top5", "top10")
    return fidelity.join(found, [run, key]).groupBy(run).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
