"""Splits that keep related records together: hash-to-min components, rendezvous assignment.

A unit is tied to others through the targets it names within its dataset, so the
graph is one of targets: far smaller than the units, and its edges are stars, one
per distinct set of targets, never all pairs.  Hash-to-min lets every node send
its cluster to the cluster's smallest node and that node's name back to the
others, as rows, until nothing changes.  Whole components are then given to
splits by weighted rendezvous hashing; none is placed by any other rule.

Defined results: units without a dataset or a named target are groups of their
own; a group of one keeps its unit's id; an empty table gives no row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.labels import canonical_targets, dataset_key
from vectrail.session import release, scratch

#: How strongly a group leans to the larger side, per share of all units it holds.
LEAN = 30.0
#: Bins in which a threshold is looked for at once.
BINS = 1024


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    A cluster is kept as rows (node, member), so none is ever one task's or one
    row's burden.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = both.select("a", F.col("a").alias("b"))
    clusters = scratch(both.unionByName(own).distinct().select(F.col("a").alias("node"), F.col("b").alias("member")))
    seen = None
    while True:
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = clusters.join(least, "node")
        old, clusters = clusters, scratch(
            sent.select(F.col("least").alias("node"), "member")
            .unionByName(sent.select(F.col("member").alias("node"), F.col("least").alias("member")))
            .distinct()
        )
        release(old)
        now = clusters.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "member"))).first()
        if now == seen:
            break
        seen = now
    return clusters.groupBy("node").agg(F.min("member").alias("root"))


def groups(units: DataFrame, held_out: DataFrame) -> DataFrame:
    """(unit_id, group_id) of every unit; group_id is the smallest unit_id of the group.

    ``units``: (unit_id, dataset_id, perturbation_label); ``held_out``: (dataset_id, label), labels
    whose targets are all tied within their dataset.
    """
    units = scratch(units.select("unit_id", "dataset_id", "perturbation_label"))
    held_out = held_out.select("dataset_id", "label")
    labels = (
        units.select(F.col("perturbation_label").alias("label"), F.lit(1).alias("n"))
        .unionByName(held_out.select("label", F.lit(1).alias("n")))
        .where("label IS NOT NULL")
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )
    named = scratch(canonical_targets(labels))
    keyed = scratch(
        units.join(named, units["perturbation_label"] == named["label"], "left").select(
            "unit_id", dataset_key("dataset_id").alias("dataset"), "names"
        )
    )
    tied = keyed.where("dataset IS NOT NULL AND size(names) > 0")
    sets = (
        tied.select("dataset", "names")
        .unionByName(held_out.join(named, "label").select(dataset_key("dataset_id").alias("dataset"), "names"))
        .where("dataset IS NOT NULL")
        .distinct()
    )
    node = lambda name: F.xxhash64(F.col("dataset"), name)
    first = F.element_at("names", 1)
    edges = sets.select(node(first).alias("a"), F.explode("names").alias("n"), "dataset").select("a", F.xxhash64("dataset", "n").alias("b"))
    roots = scratch(hash_to_min(edges.distinct()))
    placed = tied.select("unit_id", node(first).alias("node")).join(roots, "node").select("unit_id", "root")
    smallest = placed.groupBy("root").agg(F.min("unit_id").alias("group_id"))
    alone = keyed.where("dataset IS NULL OR names IS NULL OR size(names) = 0")
    return placed.join(smallest, "root").select("unit_id", "group_id").unionByName(
        alone.select("unit_id", F.col("unit_id").alias("group_id"))
    )


def assign(grouped: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(unit_id, group_id, split): whole groups, the splits' shares of units as near as the groups allow.

    Every group goes by weighted rendezvous hashing, first between the largest split and
    the rest, then among the rest.  Of two sides the first one wins a group where its score
    is higher, that is where the difference of the two hashed scores passes the difference
    of the sides' weights; the weights are set where the first side's share of units comes
    nearest to the wanted one (``_threshold``).  A group of a notable share of all units
    leans towards the first side by ``LEAN`` times that share, so that it is rarely the one
    that the threshold parts from the others.  A group's place depends on its id, its size
    and the weights only: new units move no group but those next to a threshold.
    """
    order = sorted(shares, key=lambda s: (-shares[s], s))
    left = scratch(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")))
    placed: list[DataFrame] = []
    rest = sum(shares.values())
    for split in order[:-1]:
        total = left.agg(F.sum("n")).first()[0] or 0
        scored = left.withColumn("score", _odds(split, seed) + F.lit(LEAN / max(1, total)) * F.col("n"))
        limit = _threshold(scored, total * shares[split] / rest)
        placed.append(scored.where(F.col("score") >= limit).select("group_id", F.lit(split).alias("split")))
        left, rest = scored.where(F.col("score") < limit).select("group_id", "n"), rest - shares[split]
    placed.append(left.select("group_id", F.lit(order[-1]).alias("split")))
    return grouped.join(reduce(DataFrame.unionByName, placed), "group_id").select("unit_id", "group_id", "split")


def _odds(split: str, seed: int) -> Column:
    """The difference of two rendezvous scores -1 / ln(u), as logarithms, one hashed for the split and one for the rest."""

    def score(side: str) -> Column:
        unit = (F.pmod(F.xxhash64("group_id", F.lit(side), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        return -F.log(-F.log(unit))

    return score(split) - score(f"not {split}")


def _threshold(scored: DataFrame, want: float) -> float:
    """The score from which on the groups' sizes sum up nearest to ``want``; from sums over ever finer bins."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return 0.0
    above, low, high = 0, low, high + 1.0
    while True:
        width = (high - low) / BINS
        inside = scored.where((F.col("score") >= F.lit(low)) & (F.col("score") < F.lit(high)))
        bins = inside.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("score") - F.lit(low)) / F.lit(width))).alias("bin")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min("score").alias("low"), F.max("score").alias("high")
        )
        rows = sorted(bins.collect(), key=lambda r: -r["bin"])  # BINS rows at most
        for k, r in enumerate(rows):
            if above + r["n"] >= want or k == len(rows) - 1:
                break
            above += r["n"]
        if r["c"] == 1 or r["low"] == r["high"]:
            # The last group goes where it leaves the sum nearer to what is wanted.
            return r["low"] if above + r["n"] - want <= want - above else math.nextafter(r["high"], math.inf)
        low, high = r["low"], math.nextafter(r["high"], math.inf)


def balance(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(split, wanted, n_units, n_parted, within): of each split, whether its share misses the wanted one by the largest group at most."""
    spark = assigned.sparkSession
    each = assigned.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), F.max("split").alias("other"))
    total, largest, parted = each.agg(F.sum("n"), F.max("n"), F.count_if(F.col("split") != F.col("other"))).first()
    got = each.groupBy("split").agg(F.sum("n").alias("n"))
    wanted = spark.createDataFrame(sorted(shares.items()), "split string, wanted double")
    miss = F.abs(F.coalesce(F.col("n"), F.lit(0)) - F.col("wanted") * F.lit(total or 0))
    return wanted.join(got, "split", "left").select(
        "split", "wanted", F.lit(total or 0).cast("long").alias("n_units"), F.lit(parted).cast("long").alias("n_parted"), (miss <= F.lit(largest or 0)).alias("within")
    )
