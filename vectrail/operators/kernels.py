"""The few numeric kernels that no composition of built-ins expresses: ridge, rank test, embeddings.

Each works on one evaluation's matrix at a time, whose size the split fixes; groups
are distributed, and nothing reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.operators.relational import grouped_quantiles, grouped_running
from vectrail.session import scratch

EPS = 1e-8
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def ridge_dual(x: np.ndarray, y: np.ndarray, q: np.ndarray, alphas: tuple[float, ...] = ALPHAS) -> dict[float, np.ndarray]:
    """Predictions at ``q`` for every alpha from one eigendecomposition of the centred Gram matrix."""
    mx, my = x.mean(0), y.mean(0)
    xc, qc = x - mx, q - mx
    values, vectors = np.linalg.eigh(xc @ xc.T)
    rotated = vectors.T @ (y - my)
    cross = qc @ xc.T @ vectors
    out = {}
    for alpha in alphas:
        d = np.maximum(values, 0.0) + alpha
        d = np.where(np.abs(d) <= EPS, EPS, d)
        out[alpha] = cross @ (rotated / d[:, None]) + my
    return out


def safe_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = np.zeros(len(a))
    good = na * nb > EPS
    out[good] = (a * b).sum(1)[good] / (na * nb)[good]
    out[(na <= EPS) & (nb <= EPS)] = 1.0
    return np.clip(out, -1, 1)


def one_hot(train: pd.DataFrame, other: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of the categories seen in ``train``; unseen ones are all zero."""
    a, b = [], []
    for c in columns:
        levels = sorted(train[c].fillna("").astype(str).unique())
        a.append((train[c].fillna("").astype(str).to_numpy()[:, None] == np.array(levels)[None, :]).astype(float))
        b.append((other[c].fillna("").astype(str).to_numpy()[:, None] == np.array(levels)[None, :]).astype(float))
    return np.hstack(a), np.hstack(b)


def signed_rank_p(n: int, plus: float, ties: float, zeros: bool) -> float:
    """Two-sided signed-rank test of ``n`` differences other than zero, whose positive ones have the rank sum ``plus``.

    Exact for up to 50 differences without ties or zeros, else the normal approximation; ``ties`` is the sum of
    t^3 - t over groups of t equal sizes.
    """
    if n < 1:
        return 1.0
    if n <= 50 and not ties and not zeros:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1.0
        for r in range(1, n + 1):
            counts[r:] = counts[r:] + counts[:-r].copy()
        tail = min(plus, n * (n + 1) / 2 - plus)
        return float(min(1.0, 2.0 * counts[: int(tail) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if var <= 0:
        return 1.0
    return float(math.erfc(abs(plus - mean) / math.sqrt(var) / math.sqrt(2.0)))


def rank_tests(pairs: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """(keys, n_pairs, mean_diff, median_diff, p_value_raw) of the matched differences of each group.

    Ranks, sums and medians are distributed however many differences a group has; only one row of sums a group
    reaches Python.  Fewer than two differences, or none other than zero, give 1.
    """
    rows = scratch(pairs.where(F.col(diff).isNotNull() & ~F.isnan(diff)).select(*keys, F.col(diff).cast("double").alias("_d")))
    kinds = dict(pairs.dtypes)
    flat = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("_d").alias("mean_diff"), F.count_if(F.col("_d") == 0).alias("_zeros"), F.max(F.abs("_d")).alias("_far")
    )
    counts = rows.where("_d <> 0").groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"))
    upto = grouped_running(counts, keys, [F.col("_size")], {"_upto": F.col("_c")})
    c = F.col("_c").cast("double")
    sums = upto.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_up") * (F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0))).alias("_plus"), F.sum(c * c * c - c).alias("_ties")
    )
    median = grouped_quantiles(rows, keys, "_d", [0.5]).select(*keys, F.col("quantile").alias("median_diff"))
    # Keys are never null: model pairs match on equal, known contexts.
    table = flat.join(sums, keys, "left").join(median, keys, "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = pdf[["n_pairs", "_far", "_n", "_plus", "_ties", "_zeros"]].fillna(0).to_numpy(float)
            p = [1.0 if n < 2 or far <= 1e-8 else signed_rank_p(int(k), plus, ties, zeros > 0) for n, far, k, plus, ties, zeros in stats]
            yield pdf[[*keys, "n_pairs", "mean_diff", "median_diff"]].assign(p_value_raw=p)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_pairs long, mean_diff double, median_diff double, p_value_raw double"
    return table.mapInPandas(finish, schema)


def embedding(train: np.ndarray, most: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, components) of a standardised principal component embedding fitted on ``train``."""
    mean, scale = train.mean(0), train.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (train - mean) / scale
    n = max(1, min(most, len(train) - 1, train.shape[1]))
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    v = vt[:n]
    signs = np.sign(v[np.arange(len(v)), np.argmax(np.abs(v), axis=1)])
    return mean, scale, v * np.where(signs == 0, 1, signs)[:, None]


def linear_mmd(x: np.ndarray, y: np.ndarray) -> float:
    return float(((x.mean(0) - y.mean(0)) ** 2).sum())


def _mean_distance(x: np.ndarray, y: np.ndarray, within: bool) -> float:
    """Mean distance over x times y, or over the pairs i < j of x; a block of rows at a time."""
    if within and len(x) < 2:
        return 0.0
    acc = 0.0
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        sq = (part**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * part @ y.T
        acc += np.sqrt(np.maximum(sq, 0.0)).sum() if not within else sum(
            np.linalg.norm(x[lo + k + 1 :] - part[k], axis=1).sum() for k in range(len(part))
        )
    return float(acc / (len(x) * (len(x) - 1) / 2 if within else len(x) * len(y)))


def energy_distance(x: np.ndarray, y: np.ndarray) -> float:
    return max(0.0, 2 * _mean_distance(x, y, False) - _mean_distance(x, x, True) - _mean_distance(y, y, True))


def sliced_wasserstein(x: np.ndarray, y: np.ndarray, directions: int = 128, seed: int = 0) -> float:
    """Mean one-dimensional transport distance over fixed random directions."""
    d = np.random.default_rng(seed).normal(size=(directions, x.shape[1]))
    d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), EPS)
    px, py = np.sort(x @ d.T, axis=0), np.sort(y @ d.T, axis=0)
    # The area between the two quantile functions, which are flat between multiples of 1/n and of 1/m.
    edges = np.union1d(np.arange(1, len(px) + 1) / len(px), np.arange(1, len(py) + 1) / len(py))
    width = np.diff(edges, prepend=0.0)
    at = lambda q: np.minimum(np.ceil((edges - width / 2) * len(q)).astype(int) - 1, len(q) - 1)
    return float((np.abs(px[at(px)] - py[at(py)]) * width[:, None]).sum(0).mean())


BLOCK = 1024


def blocks(df: DataFrame, run: str, key: str, columns: list[str]) -> DataFrame:
    """(run, block, rows): each run's rows in blocks of about ``BLOCK`` by the hash of their key."""
    sizes = df.groupBy(run).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_b"))
    placed = df.join(sizes, run).withColumn("block", F.pmod(F.xxhash64(key), F.col("_b")))
    return placed.groupBy(run, "block").agg(F.collect_list(F.struct(key, *[c for c in columns if c != key])).alias("rows"))  # a block, not a group


def energy_distances(df: DataFrame, run: str, key: str, truth: str, guess: str) -> DataFrame:
    """(run, energy_distance) of truths against guesses; a task holds two blocks, whatever a run's size."""
    cut_up = blocks(df.select(run, key, F.col(truth).alias("t"), F.col(guess).alias("p")), run, key, [key, "t", "p"])
    kind = dict(df.dtypes)[run]
    a, b = cut_up.withColumnsRenamed({"block": "i", "rows": "a"}), cut_up.withColumnsRenamed({"block": "j", "rows": "b"})

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, left, right in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
                m = [np.array([r[c] for r in rows], float) for rows in (left, right) for c in ("t", "p")]
                between = lambda x, y: np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0.0)).sum()
                alone = lambda x: sum(np.linalg.norm(x[k + 1 :] - x[k], axis=1).sum() for k in range(len(x) - 1))
                tt, pp = (alone(m[0]), alone(m[1])) if i == j else (between(m[0], m[2]), between(m[1], m[3])) if i < j else (0.0, 0.0)
                out.append((between(m[0], m[3]), tt, pp, len(left) if i == j else 0))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.float64()) for c in cols[:3]], pa.array(list(cols[3]), pa.int64())], names=["r", "tp", "tt", "pp", "n"])

    parts = a.join(b, run).select(F.col(run).alias("r"), "i", "j", "a", "b").mapInArrow(run_pairs, f"r {kind}, tp double, tt double, pp double, n long")
    n = F.sum("n").cast("double")
    within = lambda c: F.coalesce(F.try_divide(F.sum(c), n * (n - 1) / 2), F.lit(0.0))
    return parts.groupBy(F.col("r").alias(run)).agg(F.greatest(F.lit(0.0), 2 * F.sum("tp") / (n * n) - within("tt") - within("pp")).alias("energy_distance"))


def distribution_distances(df: DataFrame, run: str, part: str, truth: str, guess: str, control: str, least: tuple[int, int] = (10, 5)) -> DataFrame:
    """(run, status, dims, mmd_linear, energy_distance, sliced_wasserstein_128) of test truths against guesses.

    The embedding is fitted on the run's train truths that aren't controls; too few rows give an unsupported row.
    """
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        real = pdf[~pdf[control].astype(bool)]
        train, test = real[real[part] == "train"], real[real[part] == "test"]
        row = {run: pdf[run].iloc[0], "status": "unsupported", "dims": 0, "mmd_linear": None, "energy_distance": None, "sliced_wasserstein_128": None}
        if len(train) >= least[0] and len(test) >= least[1]:
            mean, scale, v = embedding(np.array(train[truth].tolist(), float))
            x = ((np.array(test[truth].tolist(), float) - mean) / scale) @ v.T
            y = ((np.array(test[guess].tolist(), float) - mean) / scale) @ v.T
            row |= {"status": "ok", "dims": len(v), "mmd_linear": linear_mmd(x, y), "energy_distance": energy_distance(x, y), "sliced_wasserstein_128": sliced_wasserstein(x, y)}
        return pd.DataFrame([row])

    schema = f"{run} {kinds[run]}, status string, dims int, mmd_linear double, energy_distance double, sliced_wasserstein_128 double"
    return df.select(run, part, truth, guess, control).groupBy(run).applyInPandas(one, schema)
