"""The same or nearly the same records across splits, by content-defined chunks.

A record names a set of targets; its normalised form has one line for each target
and one for each letter left out of it, so that two spellings one slip apart have
a line in common.  The lines are cut into content-defined chunks where a rolling
hash of their bytes says so, and at their ends.  Chunk digests are joined; the
lengths of shared chunks, summed, give the share of one text that another holds.
Texts meet on their rarest chunks only: as many as hold more than what two texts
one slip apart may differ in, so that every such pair meets and a chunk that many
texts hold joins little.

The texts that meet are the spellings of single targets, so that two misspellings
of one record are found to be the same even where no record has it rightly spelt.
What meets and shares enough is then checked exactly: a spelling is that of the
best attested one a slip away, if it is hardly attested itself.  Records are the
same whose targets, dataset and reference are.  Nothing is repaired before the
chunks have met; a spelling that does not meet itself gives its records no class,
so without the chunks no pair comes out, not even one of equal records.

Defined results: records without a dataset, reference or named target match
nothing; null splits match nothing; an empty side gives no pair.  Names of
``LONG`` letters and more have lines for their beginning and end: a slip leaves
one of the two whole.  A chunk counts 65,535 bytes at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.labels import dataset_key, one_slip, reference_key, targets
from vectrail.session import scratch

WINDOW = 4
LONG = 64
#: A boundary falls where the rolling hash has these bits clear: chunks of about eight bytes.
MASK = np.uint64(0b111 << 40)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LINK = np.uint64(0xD6E8FEB86659FD93)


def chunk_batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of every chunk of ``texts``, all at once."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(total) - start
    with np.errstate(over="ignore"):
        roll = np.zeros(total, dtype=np.uint64)
        power = np.uint64(1)
        for back in range(WINDOW):
            part = np.zeros(total, dtype=np.uint64)
            part[back:] = data[: total - back] * power
            roll += np.where(place >= back, part, np.uint64(0))
            power = power * _BASE
        roll ^= roll >> np.uint64(29)
        cut = (roll * _LINK) & MASK == 0
        last = place == np.repeat(sizes, sizes) - 1
        ends = np.flatnonzero(cut | last)
        begins = np.concatenate(([0], ends[:-1] + 1))
        length = (ends - begins + 1).astype(np.int32)
        inner = np.arange(total) - np.repeat(begins, length)
        powers = np.cumprod(np.full(int(length.max()), _LINK, dtype=np.uint64))
        digest = np.add.reduceat(data * powers[inner], begins)
        digest ^= digest >> np.uint64(31)
        digest = digest * _BASE
    return owner[ends], digest.view(np.int64), length


def _lines(name: str) -> list[str]:
    """The lines of a target written as ``stem:number``: it, it with each letter of the stem left out, and the ends of a long one."""
    stem, num = name.rsplit(":", 1)
    lines = [stem + num]
    if len(stem) <= LONG:
        lines += [stem[:i] + stem[i + 1 :] + num for i in range(len(stem))]
    if len(stem) >= LONG:  # powers of two, so that names whose lengths differ by one have one in common
        for size in {1 << ((n - 2) // 2).bit_length() - 1 for n in (len(stem) - 1, len(stem))}:
            lines += [stem[:size], stem[-size:]]
    return list(dict.fromkeys(lines))


def chunked(texts: DataFrame) -> DataFrame:
    """(tid, n, names, keys, need): each text's distinct chunks, and the bytes any text one slip away must share with it.

    ``texts`` has (tid, names, n).  A key is a chunk's digest with the chunk's length in its lowest 16 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, of_text, of_name, n = [], [], [], 0
            for i, names in enumerate(batch.column(1).to_pylist()):
                for name in names:
                    mine = _lines(name)
                    lines += mine
                    of_text += [i] * len(mine)
                    of_name += [n] * len(mine)
                    n += 1
            owner, digest, length = chunk_batch([t.encode() for t in lines])
            size = np.minimum(length, 65535).astype(np.uint64)
            text = np.array(of_text, np.int64)[owner]
            key = digest.view(np.uint64) & ~np.uint64(0xFFFF) | size
            need = _needs(batch.num_rows, of_text, of_name, owner, key)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            ends = np.searchsorted(text[fresh], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[fresh].view(np.int64))), pa.array(need, pa.int32())],
                names=["tid", "n", "names", "keys", "need"],
            )

    return texts.select("tid", "names", "n").mapInArrow(run, "tid long, n long, names array<string>, keys array<long>, need int")


def _needs(rows: int, of_text: list[int], of_name: list[int], owner: np.ndarray, key: np.ndarray) -> list[int]:
    """Per text, the least bytes of distinct chunks it shares with any text in which one of its names has a slip."""
    lines: list[set[int]] = [set() for _ in of_text]
    for line, k in zip(owner.tolist(), key.tolist()):
        lines[line].add(k)
    names: dict[int, dict[int, list[set[int]]]] = {}
    for line, (t, n) in enumerate(zip(of_text, of_name)):
        names.setdefault(t, {}).setdefault(n, []).append(lines[line])
    weigh = lambda ks: sum(k & 0xFFFF for k in ks)
    out = []
    for t in range(rows):
        mine = names.get(t, {})
        each = {n: set().union(*ls) for n, ls in mine.items()}
        held = Counter(k for ks in each.values() for k in ks)
        total = weigh(held)
        least = []
        for n, ls in mine.items():
            others = total - weigh(k for k in each[n] if held[k] == 1)
            least.append(max(others, min(map(weigh, ls))))
        out.append(max(1, min(least, default=1)))
    return out


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s + k.bitwiseAND(0xFFFF))


def overlaps(texts: DataFrame) -> DataFrame:
    """(a, b, share, x, y, an, bn): texts b that hold at least the needed part of a; share is that part of a's bytes.

    ``texts`` has (tid, names, n); of two texts, a is the one seen less often (or the later id), and every
    text meets itself; x and y are their names, an and bn how often they are seen.
    """
    cut_up = scratch(chunked(texts))
    each = cut_up.select("tid", "need", "n", F.explode("keys").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
    per = Window.partitionBy("tid")
    rare_first = per.orderBy("freq", "key").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("key").bitwiseAND(0xFFFF)
    ranked = each.join(common, "key").withColumn("total", F.sum(size).over(per)).withColumn("before", F.coalesce(F.sum(size).over(rare_first), F.lit(0)))
    # Chunks behind the prefix together hold less than is needed: two texts that share enough have a chunk of both prefixes in common.
    prefix = ranked.where(F.col("total") - F.col("before") >= F.col("need")).select("tid", "n", "key")
    mine = prefix.select(F.col("tid").alias("a"), F.col("n").alias("an"), "key")
    theirs = prefix.select(F.col("tid").alias("b"), F.col("n").alias("bn"), "key")
    better = (F.col("bn") > F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("b") <= F.col("a")))
    met = mine.join(theirs, "key").where(better).select("a", "b").distinct()
    held = cut_up.select(F.col("tid").alias("a"), F.col("keys").alias("ka"), F.col("need").alias("na"), F.col("names").alias("x"), F.col("n").alias("an"))
    by = cut_up.select(F.col("tid").alias("b"), F.col("keys").alias("kb"), F.col("need").alias("nb"), F.col("names").alias("y"), F.col("n").alias("bn"))
    shared = _weight(F.array_intersect("ka", "kb"))
    return (
        met.join(held, "a").join(by, "b")
        .select("a", "b", "na", "nb", "x", "y", "an", "bn", shared.alias("shared"), (shared / _weight(F.col("ka"))).alias("share"))
        .where("shared >= greatest(na, nb)")
        .select("a", "b", "share", "x", "y", "an", "bn")
    )


def spellings(stems: DataFrame) -> DataFrame:
    """(stem, cls): the spelling each of ``stems`` (stem, n) stands for; itself where none is better.  Stems that do not meet themselves are left out.

    A spelling of three letters or more stands for the best attested one a slip away, the first of those equally attested, if it
    is seen twice at most or eight times less often.  That one is not followed further: two slips make another name.
    """
    texts = stems.select(F.xxhash64("stem").alias("tid"), F.array(F.concat("stem", F.lit(":"))).alias("names"), "n")
    stem = lambda c: F.regexp_replace(F.col(c)[0], ":$", "")
    met = scratch(overlaps(texts).select(stem("x").alias("x"), stem("y").alias("y"), "an", "bn"))
    turned = (F.col("an") == F.col("bn")) & (F.col("x") < F.col("y"))  # of two equally attested, the first is the better
    slips = (
        met.where("x <> y AND length(x) >= 3 AND length(y) >= 3 AND (an <= 2 OR bn >= 8 * an)").where(one_slip("x", "y"))
        .select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("stem"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("to"), "bn")
    )
    best = slips.groupBy("stem").agg(F.min_by("to", F.struct(-F.col("bn"), F.col("to"))).alias("to"))
    return met.where("x = y").select(F.col("x").alias("stem")).join(best, "stem", "left").select("stem", F.coalesce("to", "stem").alias("cls"))


def cross_split(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the units with their place (split, dataset and reference), their text and its class, and
    the pairs of texts of one class with their shares.

    ``units``: (unit_id, split_id, split_part, dataset_id, reference_key, perturbation_label), controls left out.
    """
    label = "perturbation_label"
    labels = scratch(units.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("targets", targets(label)))
    parts = labels.select(label, "n", F.explode("targets").alias("t")).select(label, "n", "t.stem", "t.num")
    known = scratch(spellings(scratch(parts.groupBy("stem").agg(F.sum("n").alias("n")))))
    written = F.array_sort(F.array_distinct(F.transform("targets", lambda t: F.concat(t["stem"], F.lit(":"), t["num"]))))
    meant = parts.join(known, "stem").groupBy(label).agg(F.array_sort(F.collect_set(F.concat("cls", "num"))).alias("meant"))
    texts = scratch(
        labels.join(meant, label).select(label, written.alias("names"), "meant")
        .select(label, "names", F.xxhash64("names").alias("tid"), F.xxhash64("meant").alias("cls"))
    )
    members = scratch(
        units.where("split_id IS NOT NULL AND split_part IN ('train', 'validation', 'test')")
        .select(
            "unit_id", F.col("split_id").alias("split"), (F.col("split_part") == "train").alias("train"), dataset_key("dataset_id").alias("dataset"),
            reference_key("reference_key").alias("reference"), label,
        )
        .withColumn("place", F.when(F.col("dataset").isNotNull() & F.col("reference").isNotNull(), F.xxhash64("split", "dataset", "reference")))
        .join(texts.drop("names"), label, "left")
        .select("unit_id", "split", "train", "dataset", "place", "tid", "cls")
    )
    return members, _class_pairs(members, texts)


def _class_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, share): texts of one class, with the part of a's bytes that b holds; a is seen less often, or has the later id."""
    seen = members.where("place IS NOT NULL AND tid IS NOT NULL").groupBy("tid").agg(F.first("cls").alias("cls"), F.count(F.lit(1)).alias("n"))
    named = texts.groupBy("tid").agg(F.first("names").alias("names"))
    cut_up = chunked(seen.join(named, "tid").select("tid", "names", "n")).join(seen.select("tid", "cls"), "tid")
    a = cut_up.select("cls", F.col("tid").alias("a"), F.col("n").alias("an"), F.col("keys").alias("ka"))
    b = cut_up.select("cls", F.col("tid").alias("b"), F.col("n").alias("bn"), F.col("keys").alias("kb"))
    better = (F.col("bn") > F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("b") <= F.col("a")))
    return a.join(b, "cls").where(better).select("a", "b", (_weight(F.array_intersect("ka", "kb")) / _weight(F.col("ka"))).alias("share"))


def same_units(members: DataFrame) -> DataFrame:
    """(unit_id_a, unit_id_b, held_unit): held-out and train units of one split whose records are the same."""
    held = members.where("NOT train").select("place", "cls", F.col("unit_id").alias("h"))
    train = members.where("train").select("place", "cls", F.col("unit_id").alias("t"))
    return held.join(train, ["place", "cls"]).select(F.least("h", "t").alias("unit_id_a"), F.greatest("h", "t").alias("unit_id_b"), F.col("h").alias("held_unit"))


def report(members: DataFrame) -> DataFrame:
    """(split_id, dataset, n_held, n_met, n_pairs): held-out units, those met in train, and the pairs they make."""
    trained = members.where("train AND cls IS NOT NULL").groupBy("place", "cls").agg(F.count(F.lit(1)).alias("partners"))
    return (
        members.where("NOT train").join(trained, ["place", "cls"], "left")
        .groupBy(F.col("split").alias("split_id"), "dataset")
        .agg(F.count(F.lit(1)).alias("n_held"), F.count("partners").alias("n_met"), F.coalesce(F.sum("partners"), F.lit(0).cast("long")).alias("n_pairs"))
    )


def shares(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit_id, share): per held-out unit the part of its record that the nearest of the same train records holds.

    1 for an equal record, less for one with a slip, 0 where there is none.  Of two records one slip apart the share
    is the one of the record seen less often.
    """
    texts = members.where("tid IS NOT NULL AND train").select("place", "cls", F.col("tid").alias("t")).distinct()
    held = members.where("NOT train").select("unit_id", "place", "cls", "tid")
    met = held.join(texts, ["place", "cls"]).select("unit_id", "tid", "t")
    there, back = pairs.select(F.col("a").alias("tid"), F.col("b").alias("t"), "share"), pairs.where("a <> b").select(F.col("b").alias("tid"), F.col("a").alias("t"), "share")
    best = met.join(there.unionByName(back), ["tid", "t"]).groupBy("unit_id").agg(F.max("share").alias("share"))
    return held.select("unit_id").join(best, "unit_id", "left").select("unit_id", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))
