"""Vectors held in array columns: row metrics, weighted means, profiles and distances.

Cheap row metrics are built-in higher-order functions and stay in the JVM.  The
rank-based ones (Spearman, top-k overlap, NDCG, MAP) need sorted vectors; they are
computed together, a batch of rows as one matrix, in an Arrow kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8
TOP_K = (20, 50, 100)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: str | Column) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def total(v: str | Column) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in [-1, 1]; 0 where the product of norms vanishes, 1 where both norms do, null for a null vector."""
    na, nb = norm(a), norm(b)
    raw = F.when(na * nb > EPS, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
    bound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return F.when(na.isNotNull() & nb.isNotNull(), F.when((na <= EPS) & (nb <= EPS), F.lit(1.0)).otherwise(bound))


def rmse(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))) / F.size(_c(a)))


def mae(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))) / F.size(_c(a))


def unit(v: str | Column) -> Column:
    """The vector over its norm, the norm floored at EPS."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(_c(v), lambda x: x / n)


def diagnostics(v: str | Column) -> list[Column]:
    """Mean, mean size, population deviation, norm and largest size of a vector's elements."""
    x, n = _c(v), F.size(_c(v))
    mean = total(x) / n
    return [
        mean.alias("vec_mean"),
        (F.aggregate(x, F.lit(0.0), lambda a, e: a + F.abs(e)) / n).alias("vec_abs_mean"),
        F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e) / n - mean * mean).alias("vec_std"),
        norm(x).alias("vec_l2"),
        F.array_max(F.transform(x, lambda e: F.abs(e))).alias("vec_max_abs"),
    ]


def project(v: str | Column, positions: list[int]) -> Column:
    """The vector's elements at ``positions``, in that order."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.element_at(_c(v), p + 1))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, name: str = "mean_vector") -> DataFrame:
    """The (weighted) mean vector of each group; unweighted where the weights sum to nothing.

    Elements are summed by position, partly before the shuffle, so no group is gathered.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    each = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    sums = each.groupBy(*keys, "_pos").agg(
        F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.sum("_w").alias("_n"), F.avg("_x").alias("_a")
    )
    value = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.col("_a"))
    packed = F.array_sort(F.collect_list(F.struct("_pos", value.alias("_v"))))  # one entry a position
    return sums.groupBy(*keys).agg(F.transform(packed, lambda e: e["_v"]).alias(name))


def zeros_like(v: str | Column) -> Column:
    return F.transform(_c(v), lambda x: F.lit(0.0))


def _average_ranks(m: np.ndarray) -> np.ndarray:
    order = np.argsort(m, axis=1, kind="stable")
    rows = np.arange(len(m))[:, None]
    s = m[rows, order]
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    place = np.broadcast_to(np.arange(m.shape[1]), s.shape)
    first = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    final = np.ones(s.shape, bool)
    final[:, :-1] = fresh[:, 1:]
    last = np.minimum.accumulate(np.where(final, place, m.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(m.shape)
    out[rows, order] = (first + last) / 2.0 + 1.0
    return out


def _correlate(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = np.zeros(len(a))
    good = nx * ny > EPS
    out[good] = (x * y).sum(1)[good] / (nx * ny)[good]
    out[(nx <= EPS) & (ny <= EPS) & equal] = 1.0
    return np.clip(out, -1.0, 1.0)


def metric_matrix(t: np.ndarray, p: np.ndarray, ks: tuple[int, ...] = TOP_K) -> dict[str, np.ndarray]:
    """All row metrics of two equally shaped matrices of truths and predictions."""
    nt, np_ = np.linalg.norm(t, axis=1), np.linalg.norm(p, axis=1)
    cos = np.zeros(len(t))
    good = nt * np_ > EPS
    cos[good] = (t * p).sum(1)[good] / (nt * np_)[good]
    cos[(nt <= EPS) & (np_ <= EPS)] = 1.0
    equal = np.abs(t - p).max(1, initial=0.0) <= EPS
    flat = (np.ptp(t, axis=1) <= EPS) | (np.ptp(p, axis=1) <= EPS)
    spearman = _correlate(_average_ranks(t), _average_ranks(p), equal)
    spearman[flat] = np.where((np.ptp(t, axis=1) <= EPS) & (np.ptp(p, axis=1) <= EPS) & equal, 1.0, 0.0)[flat]
    out = {
        "cosine_similarity": np.clip(cos, -1.0, 1.0),
        "pearson": _correlate(t, p, equal),
        "spearman": spearman,
        "rmse": np.sqrt(((t - p) ** 2).mean(1)),
        "mae": np.abs(t - p).mean(1),
        "delta_norm_true": nt,
        "delta_norm_pred": np_,
    }
    top_t = np.argsort(-np.abs(t), axis=1, kind="stable")
    top_p = np.argsort(-np.abs(p), axis=1, kind="stable")
    rows = np.arange(len(t))[:, None]
    for k in ks:
        n = min(k, t.shape[1])
        in_t = np.zeros(t.shape, bool)
        in_t[rows, top_t[:, :n]] = True
        in_p = np.zeros(t.shape, bool)
        in_p[rows, top_p[:, :n]] = True
        both = in_t & in_p
        shared = both.sum(1)
        hit = in_t[rows, top_p[:, :n]]
        gain = 1.0 / np.log2(np.arange(n) + 2.0)
        precision = np.cumsum(hit, axis=1) / np.arange(1, n + 1)
        out[f"jaccard_top{k}"] = shared / (2 * n - shared)
        out[f"direction_top{k}"] = np.where(shared > 0, (both & (np.sign(t) == np.sign(p))).sum(1) / np.maximum(shared, 1), 0.0)
        out[f"recall_top{k}"] = shared / n
        out[f"ndcg_top{k}"] = (hit * gain).sum(1) / gain.sum()
        out[f"map_top{k}"] = (hit * precision).sum(1) / n
    return out


def row_metrics(df: DataFrame, keys: list[str], truth: str, guess: str, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """``keys`` plus every row metric; rows with a null or empty vector, or vectors of unlike length, give none."""
    ok = F.col(truth).isNotNull() & F.col(guess).isNotNull() & (F.size(truth) == F.size(guess)) & (F.size(truth) > 0)
    names = list(metric_matrix(np.ones((1, 2)), np.ones((1, 2)), ks))
    sub = df.where(ok).select(*keys, as_double(truth).alias("_t"), as_double(guess).alias("_p"))
    fields = [*sub.select(*keys).schema.fields]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            cols = {n: np.full(len(t), np.nan) for n in names}
            for width in {len(v) for v in t}:
                at = np.array([i for i, v in enumerate(t) if len(v) == width])
                found = metric_matrix(np.array([t[i] for i in at], float), np.array([p[i] for i in at], float), ks)
                for n in names:
                    cols[n][at] = found[n]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keys))], *[pa.array(cols[n]) for n in names]], names=[*keys, *names]
            )

    return sub.mapInArrow(run, schema)


def pathway_profiles(df: DataFrame, keys: list[str], vector: str, sets: DataFrame, least: int = 3) -> DataFrame:
    """(keys, pathway, value): mean of the member positions of each set that has enough members here.

    ``sets`` is (pathway, pos); it is joined to positions, not crossed with rows.
    """
    each = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return (
        each.join(sets, "pos")
        .groupBy(*keys, "pathway")
        .agg(F.avg("x").alias("value"), F.count(F.lit(1)).alias("members"))
        .where(F.col("members") >= least)
        .drop("members")
    )


def pathway_fidelity(df: DataFrame, keys: list[str], truth: str, guess: str, sets: DataFrame, least: int = 3) -> DataFrame:
    """(keys, pathway_cosine, pathway_direction) between the profiles of truth and guess."""
    t = pathway_profiles(df, keys, truth, sets, least).withColumnRenamed("value", "t")
    p = pathway_profiles(df, keys, guess, sets, least).withColumnRenamed("value", "p")
    nt, np_ = F.sqrt(F.sum(F.col("t") * F.col("t"))), F.sqrt(F.sum(F.col("p") * F.col("p")))
    agree = F.count_if((F.abs("t") > EPS) & (F.signum("t") == F.signum("p")))
    both = t.join(p, [*keys, "pathway"]).groupBy(*keys).agg(
        F.sum(F.col("t") * F.col("p")).alias("d"), nt.alias("nt"), np_.alias("np"),
        (agree / F.greatest(F.count_if(F.abs("t") > EPS), F.lit(1))).alias("pathway_direction"),
    )
    cos = F.when((F.col("nt") <= EPS) & (F.col("np") <= EPS), F.lit(1.0)).when(
        F.col("nt") * F.col("np") > EPS, F.col("d") / (F.col("nt") * F.col("np"))
    ).otherwise(F.lit(0.0))
    return both.select(*keys, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)).alias("pathway_cosine"), "pathway_direction")


def retrieval(df: DataFrame, run: str, key: str, label: str, truth: str, guess: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(run, key, top1, ...): whether a truth of the right label is among the k nearest to the guess.

    Guesses meet the truths of their own run only, a block of guesses with a block of truths at a time, and each
    block pair passes on its nearest few; a run of any size is spread over the cluster.
    """
    from vectrail.operators.kernels import blocks

    sub = df.select(F.col(run).alias("_r"), F.col(key).alias("k"), F.col(label).alias("l"), as_double(truth).alias("t"), as_double(guess).alias("p"))
    cut_up = blocks(sub, "_r", "k", ["k", "l", "t", "p"])
    pairs = cut_up.select("_r", F.col("rows").alias("a")).join(cut_up.select("_r", F.col("rows").alias("b")), "_r")
    kinds, deep = dict(df.dtypes), max(ks)

    def meet(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for r, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                right.sort(key=lambda x: x["k"])
                p, t = np.array([x["p"] for x in left], float), np.array([x["t"] for x in right], float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = (p @ t.T) / (np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(t, axis=1)[None, :])
                sim = np.round(np.where(np.isfinite(sim), sim, -1.0), 9)
                top = np.argsort(-sim, axis=1, kind="stable")[:, :deep]
                for i, row in enumerate(top):
                    for j in row:
                        for c, x in zip(out, (r, left[i]["k"], float(sim[i, j]), right[j]["k"], left[i]["l"] == right[j]["l"])):
                            c.append(x)
            k_type = batch.schema.field("a").type.value_type.field("k").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), pa.array(out[1], k_type), pa.array(out[2], pa.float64()), pa.array(out[3], k_type), pa.array(out[4], pa.bool_())],
                names=["r", "k", "sim", "other", "right"],
            )

    near = pairs.mapInArrow(meet, f"r {kinds[run]}, k {kinds[key]}, sim double, other {kinds[key]}, right boolean")
    place = F.row_number().over(Window.partitionBy("r", "k").orderBy(F.col("sim").desc(), "other"))  # a few rows a block
    return near.withColumn("rn", place).where(F.col("rn") <= deep).groupBy(F.col("r").alias(run), F.col("k").alias(key)).agg(
        *[F.max((F.col("right") & (F.col("rn") <= k)).cast("double")).alias(f"top{k}") for k in ks]
    )


def linear_mmd(x: DataFrame, y: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, mmd_linear): squared distance of the two mean vectors."""
    a, b = mean_vectors(x, keys, vector, name="a"), mean_vectors(y, keys, vector, name="b")
    joined = a.join(b, keys) if keys else a.join(F.broadcast(b))  # one row a side without keys
    return joined.select(*keys, total(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q))).alias("mmd_linear"))


def centroid_distance(df: DataFrame, keys: list[str], part: str, columns: list[str]) -> DataFrame:
    """(keys, centroid_l2, centroid_cosine) between the train and test means of numeric columns."""
    means = [F.avg(F.when(F.col(part) == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "test") for c in columns]
    m = df.groupBy(*keys).agg(*means)
    a, b = F.array(*[F.col(f"train_{c}") for c in columns]), F.array(*[F.col(f"test_{c}") for c in columns])
    l2 = F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    product = norm(a) * norm(b)
    return m.select(*keys, l2.alias("centroid_l2"), F.when(product > 0, 1 - dot(a, b) / product).alias("centroid_cosine"))


def row_number_in(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
