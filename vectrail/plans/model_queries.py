"""Vector metrics, splits, reference predictors and their confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators import kernels, predictors, splits, vectors
from vectrail.plans import views as v
from vectrail.plans.views import rounded, sql, sql_cos, sql_dot, sql_r

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None, *needs: str):
    def keep(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = sql(text, *needs)
        return f

    return keep


def _test_cos(guess: str) -> str:
    return f"SELECT t.run, t.signature_id, {sql_r(sql_cos('t.delta', f'(CASE WHEN t.is_control THEN list_transform(t.delta, lambda x: 0.0) ELSE {guess} END)'), 'cosine')}"


def _cos(df: DataFrame) -> DataFrame:
    return rounded(df.select("run", "signature_id", vectors.cosine("delta", "guess").alias("cosine")))


@query("slice_global_delta", f"WITH p AS (SELECT t.dataset_id, {sql_cos('t.delta', 'g.g')} AS c FROM members t JOIN gmean g USING (run) WHERE part = 'test' AND NOT is_control) SELECT dataset_id, count(*) AS n, {sql_r('avg(c)', 'mean_cosine')} FROM p GROUP BY ALL", "gmean")
def slice_global_delta(spark: SparkSession, root: str) -> DataFrame:
    """Scan, split, weighted mean effect, prediction, cosine, mean per dataset."""
    guessed = predictors.global_delta(v.members(spark, root)).where("NOT is_control")
    return rounded(guessed.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.avg(vectors.cosine("delta", "guess")).alias("mean_cosine")))


@query("v1_cosine", f"SELECT vec_id, {sql_r(sql_cos('truth', 'guess'), 'cosine')} FROM pairs", "pairs")
def v1(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.pairs(spark, root).select("vec_id", vectors.cosine("truth", "guess").alias("cosine")))


@query("v4_errors", f"SELECT vec_id, {sql_r('sqrt(list_sum(list_transform(list_zip(truth, guess), lambda p: (p[1] - p[2]) ** 2)) / len(truth))', 'rmse')}, {sql_r('list_sum(list_transform(list_zip(truth, guess), lambda p: abs(p[1] - p[2]))) / len(truth)', 'mae')}, {sql_r('sqrt(' + sql_dot('truth', 'truth') + ')', 'norm')} FROM pairs", "pairs")
def v4(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.pairs(spark, root).select("vec_id", vectors.rmse("truth", "guess").alias("rmse"), vectors.mae("truth", "guess").alias("mae"), vectors.norm("truth").alias("norm")))


_LONG = "WITH e AS (SELECT vec_id, unnest(truth) AS t, unnest(guess) AS p, unnest(range(len(truth))) AS pos FROM pairs)"


def _metrics(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return rounded(vectors.row_metrics(v.pairs(spark, root), ["vec_id"], "truth", "guess").select("vec_id", *columns))


@query("v2_pearson", f"{_LONG} SELECT vec_id, {sql_r('corr(t, p)', 'pearson')} FROM e GROUP BY vec_id", "pairs")
def v2(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "pearson")


@query("v3_spearman", f"{_LONG}, r AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY t) + (count(*) OVER (PARTITION BY vec_id, t) - 1) / 2 AS t, rank() OVER (PARTITION BY vec_id ORDER BY p) + (count(*) OVER (PARTITION BY vec_id, p) - 1) / 2 AS p FROM e) SELECT vec_id, {sql_r('corr(t, p)', 'spearman')} FROM r GROUP BY vec_id", "pairs")
def v3(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "spearman")


_TOP = _LONG + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(t) DESC, pos) AS rt, row_number() OVER (PARTITION BY vec_id ORDER BY abs(p) DESC, pos) AS rp FROM e), h AS (SELECT *, (rt <= 20 AND rp <= 20)::INT AS hit FROM r), c AS (SELECT *, sum(hit) OVER (PARTITION BY vec_id ORDER BY rp) AS run FROM h)"


@query("v6_top_overlap", f"{_TOP} SELECT vec_id, {sql_r('sum(hit) / (40 - sum(hit))', 'jaccard_top20')}, {sql_r('sum(hit) / 20', 'recall_top20')} FROM c GROUP BY vec_id", "pairs")
def v6(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "jaccard_top20", "recall_top20")


@query("v7_top_direction", f"{_TOP} SELECT vec_id, {sql_r('coalesce(sum(hit * (sign(t) = sign(p))::INT) / nullif(sum(hit), 0), 0)', 'direction_top20')} FROM c GROUP BY vec_id", "pairs")
def v7(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "direction_top20")


@query("v9_ndcg", f"{_TOP} SELECT vec_id, {sql_r('sum(CASE WHEN rp <= 20 THEN hit / log2(rp + 1) END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i))', 'ndcg_top20')} FROM c GROUP BY vec_id", "pairs")
def v9(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "ndcg_top20")


@query("v10_map", f"{_TOP} SELECT vec_id, {sql_r('sum(CASE WHEN rp <= 20 THEN hit * run / rp END) / 20', 'map_top20')} FROM c GROUP BY vec_id", "pairs")
def v10(spark: SparkSession, root: str) -> DataFrame:
    return _metrics(spark, root, "map_top20")


def _sets(spark: SparkSession) -> DataFrame:
    """Sets by position modulo 7, and one of two members that is too small to count."""
    mod = spark.range(64).select(F.concat(F.lit("set"), F.col("id") % 7).alias("pathway"), F.col("id").cast("int").alias("pos"))
    return mod.unionByName(spark.createDataFrame([("tiny", 1), ("tiny", 2)], "pathway string, pos int"))


_PATH = "WITH s AS (SELECT 'set' || (i % 7) AS pathway, i AS pos FROM range(64) t(i) UNION ALL SELECT 'tiny', 1 UNION ALL SELECT 'tiny', 2), e AS (SELECT vec_id, unnest(truth) AS t, unnest(guess) AS p, unnest(range(len(truth))) AS pos FROM pairs), q AS (SELECT vec_id, pathway, avg(t) AS t, avg(p) AS p FROM e JOIN s USING (pos) GROUP BY ALL HAVING count(*) >= 3)"


@query("v12_pathway_profile", f"{_PATH} SELECT vec_id, pathway, {sql_r('t', 'value')} FROM q", "pairs")
def v12(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vectors.pathway_profiles(v.pairs(spark, root), ["vec_id"], "truth", _sets(spark)))


@query("v13_pathway_fidelity", f"{_PATH} SELECT vec_id, {sql_r('sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p)))', 'pathway_cosine')}, {sql_r('count(*) FILTER (WHERE abs(t) > 1e-8 AND sign(t) = sign(p)) / greatest(count(*) FILTER (WHERE abs(t) > 1e-8), 1)', 'pathway_direction')} FROM q GROUP BY vec_id", "pairs")
def v13(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vectors.pathway_fidelity(v.pairs(spark, root), ["vec_id"], "truth", "guess", _sets(spark)))


@query("v14_retrieval", f"WITH s AS (SELECT p.dataset_id, p.vec_id, p.perturbation_label AS l, t.perturbation_label AS tl, row_number() OVER (PARTITION BY p.vec_id ORDER BY round({sql_dot('p.guess', 't.truth')} / (sqrt({sql_dot('p.guess', 'p.guess')}) * sqrt({sql_dot('t.truth', 't.truth')})), 9) DESC, t.vec_id) AS rn FROM pairs p JOIN pairs t ON p.dataset_id = t.dataset_id) SELECT dataset_id, vec_id, max((l = tl AND rn <= 1)::INT)::DOUBLE AS top1, max((l = tl AND rn <= 5)::INT)::DOUBLE AS top5, max((l = tl AND rn <= 10)::INT)::DOUBLE AS top10 FROM s GROUP BY ALL", "pairs")
def v14(spark: SparkSession, root: str) -> DataFrame:
    return vectors.retrieval(v.pairs(spark, root), "dataset_id", "vec_id", "perturbation_label", "truth", "guess")


@query("v16_linear_mmd", f"WITH e AS (SELECT dataset_id, unnest(truth) AS t, unnest(guess) AS p, unnest(range(len(truth))) AS pos FROM pairs), m AS (SELECT dataset_id, pos, avg(t) - avg(p) AS d FROM e GROUP BY ALL) SELECT dataset_id, {sql_r('sum(d * d)', 'mmd_linear')} FROM m GROUP BY ALL", "pairs")
def v16(spark: SparkSession, root: str) -> DataFrame:
    p = v.pairs(spark, root)
    return rounded(vectors.linear_mmd(p, p.drop("truth").withColumnRenamed("guess", "truth"), ["dataset_id"], "truth"))


@query("v15_distribution_distances")
def v15(spark: SparkSession, root: str) -> DataFrame:
    m = v.members(spark, root)
    guess = predictors.perturbation_mean(m).select("run", "signature_id", "guess")
    both = m.join(guess, ["run", "signature_id"], "left").withColumn("guess", F.coalesce("guess", "delta"))
    return kernels.distribution_distances(both, "run", "part", "delta", "guess", "is_control")


@query("v19_unit_vectors", f"SELECT vec_id, {sql_r('truth[1] / greatest(sqrt(' + sql_dot('truth', 'truth') + '), 1e-8)', 'first_element')} FROM pairs", "pairs")
def v19(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.pairs(spark, root).select("vec_id", F.element_at(vectors.unit("truth"), 1).alias("first_element")))


_DIAG = "list_sum(delta) / len(delta) AS vec_mean, list_sum(list_transform(delta, lambda x: abs(x))) / len(delta) AS vec_abs_mean, sqrt(list_sum(list_transform(delta, lambda x: x * x)) / len(delta) - (list_sum(delta) / len(delta)) ** 2) AS vec_std, sqrt(list_sum(list_transform(delta, lambda x: x * x))) AS vec_l2, list_max(list_transform(delta, lambda x: abs(x))) AS vec_max_abs"
_FIVE = ["vec_mean", "vec_abs_mean", "vec_std", "vec_l2", "vec_max_abs"]


@query("v20_diagnostics", f"WITH d AS (SELECT signature_id, {_DIAG} FROM sig) SELECT signature_id, " + ", ".join(sql_r(c, c) for c in _FIVE) + " FROM d", "sig")
def v20(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.signatures(spark, root).select("signature_id", *vectors.diagnostics("delta")))


_AVG = ", ".join(f"avg({c}) FILTER (WHERE part = '{p}') AS {p}_{c}" for p in ("train", "test") for c in _FIVE)
_A, _B = ("[" + ", ".join(f"{p}_{c}" for c in _FIVE) + "]" for p in ("train", "test"))


@query("v21_centroid_distance", f"WITH d AS (SELECT run, part, {_DIAG} FROM members), m AS (SELECT run, {_AVG} FROM d GROUP BY run) SELECT run, {sql_r(f'list_distance({_A}, {_B})', 'centroid_l2')}, {sql_r(f'1 - list_cosine_similarity({_A}, {_B})', 'centroid_cosine')} FROM m", "members")
def v21(spark: SparkSession, root: str) -> DataFrame:
    d = v.members(spark, root).select("run", "part", *vectors.diagnostics("delta"))
    return rounded(vectors.centroid_distance(d, ["run"], "part", _FIVE))


@query("v22_projection", "SELECT signature_id, array_to_string([round(delta[4], 6)::DECIMAL(18,6), round(delta[1], 6)::DECIMAL(18,6)], ' ') AS picked FROM sig", "sig")
def v22(spark: SparkSession, root: str) -> DataFrame:
    got = F.transform(vectors.project("delta", [3, 0]), lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string"))
    return v.signatures(spark, root).select("signature_id", F.array_join(got, " ").alias("picked"))


@query("a4_label_means", f"SELECT run, perturbation_label, {sql_r('sqrt(' + sql_dot('m', 'm') + ')', 'norm')}, {sql_r('m[1]', 'first_element')} FROM lmean", "lmean")
def a4(spark: SparkSession, root: str) -> DataFrame:
    m = predictors.label_means(v.members(spark, root))
    return rounded(m.select("run", "perturbation_label", vectors.norm("m").alias("norm"), F.element_at("m", 1).alias("first_element")))


@query("a5_global_mean", f"SELECT run, {sql_r('sqrt(' + sql_dot('g', 'g') + ')', 'norm')} FROM gmean", "gmean")
def a5(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.global_mean(v.members(spark, root)).select("run", vectors.norm("g").alias("norm")))


@query("j16_control_profiles", f"SELECT signature_id, {sql_r('profile[1]', 'first_element')} FROM profiled", "profiled")
def j16(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.profiled(spark, root).select("signature_id", F.element_at("profile", 1).alias("first_element")))


# Splits: the order within a split is md5(seed | unit) on both sides.


@query("d1_random_split", "SELECT dataset_id, signature_id, part FROM members", "members")
def d1(spark: SparkSession, root: str) -> DataFrame:
    return v.members(spark, root).select("dataset_id", "signature_id", "part")


def _rest(held: str, seed: int, extra: str = "") -> str:
    """The remaining rows after ``held``: train and validation, the rest's own test share unused."""
    return f"""f AS (SELECT *, {held} AS h {extra}), g AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY dataset_id, h, is_control ORDER BY md5('{seed}|' || signature_id), signature_id) AS rn FROM f WINDOW w AS (PARTITION BY dataset_id, h, is_control)),
k AS (SELECT *, least(n - 2, greatest(1, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS t FROM g)
SELECT dataset_id, signature_id, CASE WHEN h THEN 'test' WHEN n < 3 THEN 'train' WHEN rn <= t THEN 'unused' WHEN rn <= t + least(n - t - 1, greatest(1, round_even((n - t) * 0.1765::DOUBLE, 0))) THEN 'validation' ELSE 'train' END AS part FROM k"""


@query("d3_unseen_perturbation", "WITH l AS (SELECT DISTINCT dataset_id, perturbation_label FROM sig WHERE NOT is_control), c AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('2000|' || perturbation_label), perturbation_label) AS rn FROM l), q AS (SELECT dataset_id, perturbation_label, true AS hit FROM c WHERE n >= 2 AND rn <= least(n - 1, greatest(1, round_even(n * 0.20::DOUBLE, 0)))), " + _rest("coalesce(hit AND NOT is_control, false)", 0, "FROM sig LEFT JOIN q USING (dataset_id, perturbation_label)"), "sig")
def d3(spark: SparkSession, root: str) -> DataFrame:
    s = v.signatures(spark, root)
    return splits.unseen_label_parts(s, "signature_id", "perturbation_label", 0, among=["dataset_id"]).select("dataset_id", "signature_id", "part")


@query("d6_unseen_combination", "WITH " + _rest("perturbation_label IN ('P1_P2', 'P3_P4', 'P1_P9')", 3000, "FROM sig"), "sig")
def d6(spark: SparkSession, root: str) -> DataFrame:
    return splits.combination_parts(v.signatures(spark, root), "signature_id", "perturbation_label", 0, among=["dataset_id"]).select("dataset_id", "signature_id", "part")


@query("d7_low_support", "WITH c AS (SELECT dataset_id, n_cells AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n_cells, signature_id) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY dataset_id) * 0.20::DOUBLE, 0)) AS spot FROM sig WHERE NOT is_control) WHERE rn = spot), " + _rest("n_cells <= cutoff AND NOT is_control", 3000, "FROM sig JOIN c USING (dataset_id)"), "sig")
def d7(spark: SparkSession, root: str) -> DataFrame:
    return splits.low_support_parts(v.signatures(spark, root), "signature_id", "n_cells", 0, ["dataset_id"]).select("dataset_id", "signature_id", "part")


@query("d8_dataset_heldout", "WITH f AS (SELECT *, dataset_id = 'ds1' AS h FROM sig), g AS (SELECT *, count(*) OVER (PARTITION BY h, is_control) AS n, row_number() OVER (PARTITION BY h, is_control ORDER BY md5('3000|' || signature_id), signature_id) AS rn FROM f), k AS (SELECT *, least(n - 2, greatest(1, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS t FROM g) SELECT signature_id, CASE WHEN h THEN 'test' WHEN n < 3 THEN 'train' WHEN rn <= t THEN 'unused' WHEN rn <= t + least(n - t - 1, greatest(1, round_even((n - t) * 0.1765::DOUBLE, 0))) THEN 'validation' ELSE 'train' END AS part FROM k", "sig")
def d8(spark: SparkSession, root: str) -> DataFrame:
    s = v.signatures(spark, root)
    return splits.remaining_parts(s, "signature_id", 3000, F.col("dataset_id") == "ds1", None, "is_control").select("signature_id", "part")


@query("d9_external_target", "SELECT min(dataset_id) AS dataset_id FROM preprocessing_summary WHERE external_validation_ready AND split_role LIKE 'external%'")
def d9(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.tables import table

    return spark.createDataFrame([(splits.external_target(table(spark, root, "preprocessing_summary")),)], "dataset_id string")


@query("d13_split_audit", f"WITH d AS (SELECT run, part, {_DIAG} FROM members), m AS (SELECT run, {_AVG} FROM d GROUP BY run), l AS (SELECT run, count(*) FILTER (WHERE a AND b) AS perturbation_overlap_train_test FROM (SELECT run, perturbation_label, bool_or(part = 'train') AS a, bool_or(part = 'test') AS b FROM members WHERE NOT is_control GROUP BY ALL) GROUP BY run), r AS (SELECT run, count(*) FILTER (WHERE a AND b) AS reference_key_overlap_train_test FROM (SELECT run, reference_key, bool_or(part = 'train') AS a, bool_or(part = 'test') AS b FROM members GROUP BY ALL) GROUP BY run), u AS (SELECT run, count(*) FILTER (WHERE part = 'train') AS train_units, count(*) FILTER (WHERE part = 'validation') AS validation_units, count(*) FILTER (WHERE part = 'test') AS test_units, count(*) FILTER (WHERE part = 'unused') AS unused_units FROM members GROUP BY run) SELECT u.*, perturbation_overlap_train_test, reference_key_overlap_train_test, {sql_r(f'list_distance({_A}, {_B})', 'centroid_l2')}, {sql_r(f'1 - list_cosine_similarity({_A}, {_B})', 'centroid_cosine')} FROM u JOIN l USING (run) JOIN r USING (run) JOIN m USING (run)", "members")
def d13(spark: SparkSession, root: str) -> DataFrame:
    return rounded(splits.audit(v.members(spark, root), ["run"], "perturbation_label", "reference_key", "delta"))


# Predictors.


@query("m1_control_mean", f"{_test_cos('list_transform(t.delta, lambda x: 0.0)')} FROM members t WHERE part = 'test'", "members")
def m1(spark: SparkSession, root: str) -> DataFrame:
    return _cos(predictors.control_mean(v.members(spark, root)))


@query("m2_global_delta", f"{_test_cos('g')} FROM members t JOIN gmean USING (run) WHERE part = 'test'", "members", "gmean")
def m2(spark: SparkSession, root: str) -> DataFrame:
    return _cos(predictors.global_delta(v.members(spark, root)))


_PARTS = "(CASE WHEN contains(perturbation_label, '_') THEN list_filter(string_split(perturbation_label, '_'), lambda x: x <> '') ELSE [] END)"
_MIXED = f"WITH w AS (SELECT run, perturbation_label, len(c) AS k, unnest(c) AS c FROM (SELECT DISTINCT run, perturbation_label, {_PARTS} AS c FROM members WHERE part = 'test' AND NOT is_control)), j AS (SELECT w.run, w.perturbation_label, k, m FROM w JOIN lmean s ON s.run = w.run AND s.perturbation_label = w.c AND NOT contains(s.perturbation_label, '_')), q AS (SELECT run, perturbation_label FROM j GROUP BY run, perturbation_label, k HAVING count(*) = k), e AS (SELECT run, perturbation_label, unnest(m) AS x, unnest(range(len(m))) AS pos FROM j JOIN q USING (run, perturbation_label)), mixed AS (SELECT run, perturbation_label, list(a ORDER BY pos) AS mm FROM (SELECT run, perturbation_label, pos, avg(x) AS a FROM e GROUP BY ALL) GROUP BY ALL)"


@query("m3_perturbation_mean", f"{_MIXED} {_test_cos('coalesce(l.m, mixed.mm, g.g)')} FROM members t LEFT JOIN lmean l USING (run, perturbation_label) LEFT JOIN mixed USING (run, perturbation_label) LEFT JOIN gmean g USING (run) WHERE part = 'test'", "members", "lmean", "gmean")
def m3(spark: SparkSession, root: str) -> DataFrame:
    return _cos(predictors.perturbation_mean(v.members(spark, root)))


_KNN = f"WITH near AS (SELECT q.run, q.signature_id, t.delta, t.n_cells, 1 - {sql_cos('q.profile', 't.profile')} AS dist, t.signature_id AS nid FROM profiled q JOIN profiled t ON q.run = t.run AND q.perturbation_label = t.perturbation_label WHERE q.part = 'test' AND NOT q.is_control AND t.part = 'train' AND NOT t.is_control), top AS (SELECT *, min(dist) OVER (PARTITION BY run, signature_id) AS least FROM near QUALIFY row_number() OVER (PARTITION BY run, signature_id ORDER BY CASE WHEN dist <= 1e-8 THEN 0 ELSE dist END, nid) <= 5), w AS (SELECT run, signature_id, CASE WHEN least <= 1e-8 THEN CASE WHEN dist <= 1e-8 THEN n_cells ELSE 0 END ELSE n_cells / dist END AS w, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM top), k AS (SELECT run, signature_id, list(a ORDER BY pos) AS x FROM (SELECT run, signature_id, pos, sum(w * x) / sum(w) AS a FROM w GROUP BY ALL) GROUP BY ALL)"


@query("m4_context_knn", f"{_KNN} {_test_cos('coalesce(k.x, g.g)')} FROM members t LEFT JOIN k USING (run, signature_id) LEFT JOIN gmean g USING (run) WHERE part = 'test'", "profiled", "gmean")
def m4(spark: SparkSession, root: str) -> DataFrame:
    return _cos(predictors.cell_context_knn(v.profiled(spark, root), 5))


@query("m4_context_knn_selected")
def m4_selected(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.cell_context_knn(v.profiled(spark, root)).select("run", "signature_id", "selected_k", vectors.cosine("delta", "guess").alias("cosine")))


@query("m5_ridge")
def m5(spark: SparkSession, root: str) -> DataFrame:
    p = v.profiled(spark, root)
    return rounded(predictors.ridge(p).join(p.select("run", "signature_id", "delta"), ["run", "signature_id"]).select("run", "signature_id", "selected_alpha", vectors.cosine("delta", "guess").alias("cosine")))


@query("m7_error_summary", f"WITH p AS (SELECT t.run, is_control, delta, CASE WHEN is_control THEN list_transform(delta, lambda x: 0.0) ELSE g END AS guess FROM members t JOIN gmean USING (run) WHERE part = 'test'), e AS (SELECT run, is_control, list_sum(list_transform(list_zip(delta, guess), lambda p: (p[1] - p[2]) ** 2)) AS sq, list_sum(list_transform(list_zip(delta, guess), lambda p: abs(p[1] - p[2]))) AS ab, len(delta) AS n, {sql_cos('delta', 'guess')} AS c FROM p) SELECT run, " + ", ".join(f"{sql_r(f'sum(sq) FILTER (WHERE {w}) / sum(n) FILTER (WHERE {w})', f'mse_{s}')}, {sql_r(f'sum(ab) FILTER (WHERE {w}) / sum(n) FILTER (WHERE {w})', f'mae_{s}')}, {sql_r(f'avg(c) FILTER (WHERE {w})', f'mean_cosine_{s}')}" for s, w in (("non_control", "NOT is_control"), ("control", "is_control"), ("overall", "true"))) + " FROM e GROUP BY run", "members", "gmean")
def m7(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.summary(predictors.global_delta(v.members(spark, root)), ["run"]))


# Confidence.


@query("c1_control", "SELECT run, signature_id, 0.0::DOUBLE AS confidence FROM members WHERE part = 'test'", "members")
def c1(spark: SparkSession, root: str) -> DataFrame:
    return predictors.confidence_control(v.members(spark, root))


_SIM = f"centre AS (SELECT run, list(a ORDER BY pos) AS centre FROM (SELECT run, pos, avg(x) AS a FROM (SELECT run, unnest(profile) AS x, unnest(range(len(profile))) AS pos FROM profiled WHERE part = 'train') GROUP BY ALL) GROUP BY ALL), sims AS (SELECT run, signature_id, greatest(0, least(1, {sql_cos('profile', 'centre')})) AS sim FROM profiled JOIN centre USING (run) WHERE part = 'test')"


@query("c2_global", f"WITH {_SIM}, s AS (SELECT run, reference_key, sum(n_cells) AS s FROM profiled WHERE part = 'train' GROUP BY ALL), o AS (SELECT run, ln(1 + max(n_cells)) AS most FROM profiled WHERE part = 'train' GROUP BY ALL) SELECT t.run, t.signature_id, {sql_r('greatest(0, least(1, sim * CASE WHEN most <= 1e-8 THEN 1 ELSE greatest(0, least(1, ln(1 + coalesce(s, 0)) / most)) END))', 'confidence')} FROM profiled t JOIN sims USING (run, signature_id) LEFT JOIN s USING (run, reference_key) LEFT JOIN o USING (run)", "profiled")
def c2(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.confidence_global(v.profiled(spark, root)))


@query("c3_perturbation", f"WITH {_SIM}, s AS (SELECT run, perturbation_label, sum(n_cells) AS s FROM profiled WHERE part = 'train' AND NOT is_control GROUP BY ALL), o AS (SELECT run, ln(1 + max(n_cells)) AS most FROM profiled WHERE part = 'train' AND NOT is_control GROUP BY ALL), w AS (SELECT run, perturbation_label, len(c) AS k, unnest(c) AS c FROM (SELECT DISTINCT run, perturbation_label, {_PARTS} AS c FROM profiled WHERE part = 'test')), x AS (SELECT w.run, w.perturbation_label, avg(s.s) AS ms FROM w JOIN s ON s.run = w.run AND s.perturbation_label = w.c AND NOT contains(w.c, '_') GROUP BY w.run, w.perturbation_label, k HAVING count(*) = k), b AS (SELECT t.run, t.signature_id, is_control, sim, CASE WHEN s.s IS NOT NULL THEN 1.0 WHEN ms IS NOT NULL THEN 0.6 ELSE 0.2 END AS base, greatest(0, least(1, ln(1 + coalesce(s.s, ms, 0)) / most)) AS sup FROM profiled t JOIN sims USING (run, signature_id) LEFT JOIN s USING (run, perturbation_label) LEFT JOIN x USING (run, perturbation_label) LEFT JOIN o USING (run)) SELECT run, signature_id, {sql_r('greatest(0, least(1, CASE WHEN is_control THEN least(1, 0.5 + 0.5 * sim) ELSE base * (0.5 * sim + 0.5 * sup) END))', 'confidence')} FROM b", "profiled")
def c3(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.confidence_perturbation(v.profiled(spark, root)))


_UNIT = "list_transform({p}, lambda x: x / greatest(sqrt(list_dot_product({p}, {p})), 1e-8))"


@query("c4_context_knn", f"WITH u AS (SELECT *, {_UNIT.format(p='profile')} AS up FROM profiled), tr AS (SELECT * FROM u WHERE part = 'train' AND NOT is_control), o AS (SELECT run, ln(1 + max(n_cells)) AS most FROM tr GROUP BY ALL), b AS (SELECT q.run, q.signature_id, max({sql_dot('q.up', 't.up')}) AS best FROM u q JOIN tr t USING (run) WHERE q.part = 'test' GROUP BY ALL), near AS (SELECT q.run, q.signature_id, {sql_dot('q.up', 't.up')} AS sim, greatest(greatest(0, least(1, ln(1 + t.n_cells) / most)), 1e-8) AS w, t.signature_id AS nid FROM u q JOIN tr t ON q.run = t.run AND q.perturbation_label = t.perturbation_label JOIN o ON o.run = q.run WHERE q.part = 'test' AND NOT q.is_control), top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY run, signature_id ORDER BY sim DESC, nid) <= 5), k AS (SELECT run, signature_id, sum(greatest(0, least(1, sim)) * w) / sum(w) AS x FROM top GROUP BY ALL) SELECT q.run, q.signature_id, {sql_r('greatest(0, least(1, CASE WHEN is_control THEN greatest(0, coalesce(best, 0)) WHEN x IS NOT NULL THEN x ELSE 0.1 * greatest(0, coalesce(best, 0)) END))', 'confidence')} FROM u q LEFT JOIN b USING (run, signature_id) LEFT JOIN k USING (run, signature_id) WHERE q.part = 'test'", "profiled")
def c4(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.confidence_knn(v.profiled(spark, root), 5))


@query("c5_ridge")
def c5(spark: SparkSession, root: str) -> DataFrame:
    return rounded(predictors.confidence_ridge(v.profiled(spark, root)))
