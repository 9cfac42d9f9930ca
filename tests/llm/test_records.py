import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.llm import components, cutoff, overlap, percentiles, topn

NAN, INF = float("nan"), float("inf")
ODD = [None, NAN, INF, -INF]


def scored(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = r.choice(["a"] * 20 + ["b", "c", None])
        rows.append((i, g, r.choice(ODD) if r.random() < 0.05 else round(r.gauss(0, 1), r.choice([1, 4])), "x", 0))
    return rows + [(n, "empty", None, "x", 0), (n + 1, "one", -0.0, "x", 0), (n + 2, "one", 0.0, "x", 0)]


SCHEMA = "id long, g string, s double, gid string, value int"


def finite_by_group(rows):
    out = {}
    for r in rows:
        if r[2] is not None and np.isfinite(r[2]):
            out.setdefault(r[1], []).append((r[2] + 0.0, r[0]))
    return out


# Percentiles


def test_multiselect_is_exact(spark):
    rows = scored()
    got = percentiles.percentiles(spark.createDataFrame(rows, SCHEMA).repartition(5), ["g"], "s", [1, 50, 90, 100]).collect()
    want = {}
    for g, v in finite_by_group(rows).items():
        v = sorted(x for x, _ in v)
        for p in (1, 50, 90, 100):
            want[g, p] = (len(v), v[max(1, -(-len(v) * p // 100)) - 1])
    assert {(r.g, r.pct): (r.n, r.value) for r in got} == want


def test_multiselect_of_equal_values(spark):
    df = spark.createDataFrame([(i, "a", 0.5, "", 0) for i in range(500)], SCHEMA)
    assert {r.value for r in percentiles.percentiles(df, ["g"], "s", [10, 50]).collect()} == {0.5}
    assert percentiles.percentiles(df.limit(0), ["g"], "s", [50]).count() == 0


def test_days_combine_within_bound(spark):
    r = random.Random(5)
    vals = [r.gauss(0, 1) for _ in range(30000)]
    df = spark.createDataFrame([("a", v, f"2026-01-{1 + i % 9:02d} 10:00:00") for i, v in enumerate(vals)], "g string, s double, t string")
    days = percentiles.daily_sketches(df, ["g"], "s", "t")
    assert days.count() == 9
    vals.sort()
    for row in percentiles.combine_days(days, ["g"], [5, 50, 95]).collect():
        rank = np.searchsorted(vals, row.value) / len(vals)
        assert abs(rank - row.pct / 100) < 0.01 and row.n == 30000
    part = percentiles.combine_days(days.where("day < '2026-01-04'"), ["g"], [50]).first()
    assert part.n < 30000


def test_stored_days_are_kept_and_replaced(spark, tmp_path):
    at = str(tmp_path / "days")
    rows = lambda n, day: spark.createDataFrame([(None, float(i), f"2026-01-{day:02d}") for i in range(n)], "g string, s double, t string")
    for n, day in ((10, 1), (20, 2), (30, 2)):
        percentiles.store_days(percentiles.daily_sketches(rows(n, day), ["g"], "s", "t"), at)
    got = percentiles.combine_days(percentiles.stored_days(spark, at), ["g"], [50, 100])
    assert {(r.pct, r.n, r.value) for r in got.collect()} == {(50, 40, 9.0), (100, 40, 29.0)}
    both = rows(10, 1).unionByName(rows(30, 2))
    assert {r.rank_error for r in percentiles.rank_errors(got, both, ["g"], "s").collect()} == {0.0}


# Cutoffs


@pytest.mark.parametrize("k", [1024, 64, 8])
def test_cutoff_is_exact(spark, k):
    rows = scored()
    records = cutoff.prepare(spark.createDataFrame(rows, SCHEMA), ["g"], "s", "id")
    limits = cutoff.cutoffs(records, 0.8, k=k)
    got = {r.record for r in cutoff.kept(records, limits).collect()}
    want = set()
    for v in finite_by_group(rows).values():
        cut = max(c for c, _ in v if sum(x >= c for x, _ in v) >= 0.8 * len(v))
        want |= {i for x, i in v if x >= cut}
    assert got == want
    assert sum(r.n_kept for r in cutoff.report(records, limits).collect()) == len(want)


def test_brackets_that_miss_are_moved(spark, monkeypatch):
    rows = scored()
    records = cutoff.prepare(spark.createDataFrame(rows, SCHEMA), ["g"], "s", "id")
    want = {(r.sid, r.n, r.cutoff) for r in cutoff.cutoffs(records, 0.8).collect()}
    for off in (-0.3, -0.1):  # brackets of no width or turned inside out: all of them miss
        monkeypatch.setattr(cutoff, "slack", lambda k, off=off: off)
        assert {(r.sid, r.n, r.cutoff) for r in cutoff.cutoffs(records, 0.8).collect()} == want


def test_cutoff_of_nothing(spark):
    records = cutoff.prepare(spark.createDataFrame([], SCHEMA), ["g"], "s", "id")
    assert cutoff.kept(records, cutoff.cutoffs(records, 0.8)).count() == 0


# Top N


@pytest.mark.parametrize("n", [1, 5, 50])
def test_top_n(spark, n):
    rows = scored()
    got = {(r.item, r.place) for r in topn.top_n(spark.createDataFrame(rows, SCHEMA).repartition(6), ["g"], "s", "id", n).collect()}
    want = set()
    for v in finite_by_group(rows).values():
        want |= {(i, k + 1) for k, (x, i) in enumerate(sorted(v, key=lambda t: (-t[0], t[1]))[:n])}
    assert got == want


def test_top_n_all_tied_and_empty(spark):
    df = spark.createDataFrame([(i, "a", 1.0, "", 0) for i in range(100)], SCHEMA)
    assert {r.item for r in topn.top_n(df, ["g"], "s", "id", 3).collect()} == {0, 1, 2}
    assert topn.top_n(df.limit(0), ["g"], "s", "id", 3).count() == 0


# Overlaps


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60), min_size=1, max_size=8))
def test_chunks_cover_their_texts(texts):
    owner, digest, length = overlap.chunk_batch(texts)
    for i, t in enumerate(texts):
        assert length[owner == i].sum() == len(t)
    alone = [overlap.chunk_batch([t]) for t in texts]
    assert digest.tolist() == [d for a in alone for d in a[1].tolist()]


def test_chunks_survive_a_local_change():
    r = random.Random(1)
    a = bytes(r.randrange(97, 123) for _ in range(400))
    b = a[:200] + b"?" + a[201:]
    _, da, la = overlap.chunk_batch([a])
    shared = sum(n for d, n in zip(da, la) if d in set(overlap.chunk_batch([b])[1].tolist()))
    assert shared > 360


def named(rows):
    """Per text of ``rows`` (tid, names, n) its distinct chunks with their lengths, by the plain definition."""
    bags = {}
    for tid, names, _ in rows:
        bags[tid] = {}
        for line in {x for n in names for x in overlap._lines(n)}:
            for d, size in zip(*overlap.chunk_batch([line.encode()])[1:]):
                bags[tid][int(d)] = int(size)
    return bags


def slips_of(r, w):
    i = r.randrange(len(w) - 1)
    c = r.choice("abcdefgh")
    return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def test_overlap_shares_against_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.choice([3, 8, 90]))) for _ in range(12)]
    words += [slips_of(r, w) for w in words]
    rows = [(i, sorted({f"{r.choice(words)}:{r.choice(['', '1'])}" for _ in range(r.choice([1, 2, 3]))}), r.randrange(1, 9)) for i in range(150)]
    texts = spark.createDataFrame(rows, "tid long, names array<string>, n long")
    need = {x.tid: x.need for x in overlap.chunked(texts).collect()}
    got = {(x.a, x.b): round(x.share, 9) for x in overlap.overlaps(texts).collect()}
    bags, want = named(rows), {}
    for (a, _, na), (b, _, nb) in itertools.product(rows, rows):
        shared = sum(n for d, n in bags[a].items() if d in bags[b])
        if (nb, -b) >= (na, -a) and shared >= max(need[a], need[b]):
            want[a, b] = round(shared / sum(bags[a].values()), 9)
    assert got == want


def test_every_slip_shares_enough(spark):
    """Recall of the candidates: no slip of any kind, in names of any length, is lost."""
    r = random.Random(9)
    rows, pairs = [], set()
    for i in range(0, 1200, 2):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.choice([3, 4, 8, 30, 64]))) for _ in range(r.choice([1, 1, 2, 3]))]
        one = [f"{x}:{k}" for k, x in enumerate(w)]
        other = [f"{slips_of(r, w[0])}:0", *one[1:]]
        if len({x.split(":")[0] for x in [*one, *other]}) > len(w):
            rows += [(i, sorted(one), 5), (i + 1, sorted(other), 1)]
            pairs.add((i + 1, i))
    got = {(x.a, x.b): x.share for x in overlap.overlaps(spark.createDataFrame(rows, "tid long, names array<string>, n long")).collect() if x.a != x.b}
    assert pairs <= set(got) and sum(0 < got[p] < 1 for p in pairs) > 0.95 * len(pairs)


UNITS = "unit_id long, split_id string, split_part string, dataset_id string, reference_key string, perturbation_label string, label string, names int"


def units(spark):
    t, v = "train", "test"
    common = [(100 + i, "z", t, "Foo_1", "k-rep1-x", f"{w}1", "", 0) for i in range(9) for w in ("GATUPELO", "MORINASU")]
    common = [(1000 + j, *c[1:]) for j, c in enumerate(common)]
    rows = [
        (1, "s", t, "Foo_1", "k-rep1-x", "GATUPELO1_MORINASU1", "", 0), (2, "s", v, "foo-01.h5ad", "K Rep 01 X", "morinasu1; GATUPLO-1", "", 0),
        (3, "s", v, "Foo_1", "k-rep1-x", "GATUPELO1_MORINASU2", "", 0), (4, "s", v, "Foo_2", "k-rep1-x", "GATUPELO1_MORINASU1", "", 0),
        (5, "s", v, "Foo_1", "k-rep2-x", "GATUPELO1_MORINASU1", "", 0), (6, "q", v, "Foo_1", "k-rep1-x", "GATUPELO1_MORINASU1", "", 0),
        (7, "s", v, None, "k-rep1-x", "GATUPELO1_MORINASU1", "", 0), (8, "s", "validation", "Foo_1", "k-rep1-x", "GATUPELO1_MORINASU1_ctrl", "", 0),
        (9, None, t, None, None, None, "", 0), (10, "s", t, "Foo_1", "k-rep1-x", "GATUPELO1_MORINASU1", "", 0), (11, "s", v, "Foo_1", None, "control", "", 0),
    ]
    return spark.createDataFrame(rows + common, UNITS)


def test_same_units_across_splits(spark):
    m, p = overlap.cross_split(units(spark))
    got = {(r.unit_id_a, r.unit_id_b) for r in overlap.same_units(m).collect()}
    assert got == {(1, 2), (1, 8), (2, 10), (8, 10)}
    rep = {(r.split_id, r.dataset): r for r in overlap.report(m).collect()}
    assert (rep["s", "foo1"].n_met, rep["s", "foo1"].n_held, rep["s", "foo1"].n_pairs) == (2, 5, 4) and rep["s", None].n_met == 0
    share = {r.unit_id: r.share for r in overlap.shares(m, p).collect()}
    assert share[8] == 1 and 0 < share[2] < 1 and share[3] == share[7] == share[11] == 0
    m, p = overlap.cross_split(units(spark).limit(0))
    assert overlap.same_units(m).count() == overlap.shares(m, p).count() == 0


def test_without_chunks_nothing_is_found(spark, monkeypatch):
    none = F.array().cast("array<long>")
    monkeypatch.setattr(overlap, "chunked", lambda texts: texts.select("tid", "n", "names", none.alias("keys"), F.lit(1).alias("need")))
    m, _ = overlap.cross_split(units(spark))
    assert overlap.same_units(m).count() == 0


def test_two_misspellings_and_two_close_names(spark):
    rows = [(i, "s", "train" if i % 2 else "test", "D", "r-1", w, "", 0) for i, w in enumerate(["GATUPLO1", "GATTUPELO1"] + ["GATUPELO1"] * 20 + ["MORINASU1"] * 30 + ["MORINASO1"] * 30)]
    m, _ = overlap.cross_split(spark.createDataFrame(rows, UNITS))
    got = {(r.unit_id_a, r.unit_id_b) for r in overlap.same_units(m).collect()}
    word = {r[0]: r[5] for r in rows}
    assert (0, 1) in got and len(got) == 11 * 11 + 15 * 15 * 2
    assert not any({word[a], word[b]} == {"MORINASU1", "MORINASO1"} for a, b in got)


def test_misspellings_meet_without_the_right_record(spark):
    """Two misspellings of a record that is nowhere rightly spelt, slips in several targets of a record, a slip amid a name of more than 64 letters."""
    r = random.Random(6)
    long = ["".join(r.choice("abcdefgh") for _ in range(65 + i % 7)) for i in range(0, 65, 4)]
    rows = [
        (1, "s", "train", "D", "r", "GATUPLO1_MORINASU1", "", 0), (2, "s", "test", "D", "r", "GATTUPELO1_MORINASU1", "", 0),
        (3, "s", "test", "D", "r", "GATUPELO1_MORINASSU1", "", 0), (4, "s", "test", "D", "r", "GATUPLO1_MORNASU1_KELVATI", "", 0),
        (5, "s", "train", "D", "r", "GATTUPELO1_MORINASU1_KELVTI", "", 0),
    ]
    rows += [(10 + i, "z", "train", "D", "r", w, "", 0) for i, w in enumerate(["GATUPELO1", "MORINASU1", "KELVATI"] * 20)]
    rows += [(100 + 2 * i + k, "s", p, "D", "r", x, "", 0) for i, w in enumerate(long) for k, (p, x) in enumerate([("train", w), ("test", w[: 4 * i] + "q" + w[4 * i + i % 2 :])])]
    m, p = overlap.cross_split(spark.createDataFrame(rows, UNITS))
    got = {(r.unit_id_a, r.unit_id_b) for r in overlap.same_units(m).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)} | {(100 + 2 * i, 101 + 2 * i) for i in range(len(long))}
    share = {r.unit_id: r.share for r in overlap.shares(m, p).collect()}
    assert all(0 < share[u] < 1 for u in (2, 3, 4))


def test_odd_and_very_long_labels(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(50_000))
    rows = [(1, "s", "train", "D", "r", long, "", 0), (2, "s", "test", "D", "r", long[:400] + long[401:], "", 0), (3, "s", "test", "D", "r", "", "", 0), (4, "s", "test", "D", "r", ";;_", "", 0),
            (5, "s", None, "D", "r", "ABCD1", "", 0), (6, "s", "train", "D", "r", "_".join(f"GEN{i}" for i in range(2000)), "", 0), (7, "s", "validation", "d", "R", "_".join(f"GEN{i}" for i in range(2000)[::-1]), "", 0)]
    m, _ = overlap.cross_split(spark.createDataFrame(rows, UNITS))
    assert {(r.unit_id_a, r.unit_id_b) for r in overlap.same_units(m).collect()} == {(1, 2), (6, 7)}


# Components


def test_hash_to_min_on_random_graphs(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.hash_to_min(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_groups_and_shares(spark):
    rows = [(1, "D", "GATUPELO1", "", 0), (2, "d", "GATUPELO1_MORINASU2", "", 0), (3, "D", "MORINASU2", "", 0), (4, "E", "GATUPELO1", "", 0), (5, "D", "TASOBIKE3", "", 0),
            (6, "D", None, "", 0), (7, None, "GATUPELO1", "", 0), (8, "D", "LUVIDOMA4", "", 0), (9, "D", "control", "", 0), (9, "D", "control", "", 0)]
    u = spark.createDataFrame(rows[:-1], "unit_id long, dataset_id string, perturbation_label string, label string, n int")
    held = spark.createDataFrame([("D", "TASOBIKE3_LUVIDOMA4"), ("D", None), ("D", "nan"), ("D", "")], "dataset_id string, label string")
    got = {r.unit_id: r.group_id for r in components.groups(u, held).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 8: 5, 6: 6, 7: 7, 9: 9}
    assert components.groups(u.limit(0), held).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    r = random.Random(2)
    rows, i = [], 0
    for g in range(2000):
        for _ in range(1 + int(r.paretovariate(1.2)) % 300):
            rows.append((i, g))
            i += 1
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    got = components.assign(spark.createDataFrame(rows, "unit_id long, group_id long"), shares).toPandas()
    assert len(got) == len(rows) and got.groupby("group_id").split.nunique().max() == 1
    for s, n in got.split.value_counts(normalize=True).items():
        assert abs(n - shares[s]) < 0.005
    assert components.assign(spark.createDataFrame([], "unit_id long, group_id long"), shares).count() == 0
    assert components.assign(spark.createDataFrame([(1, 1), (2, 1)], "unit_id long, group_id long"), shares).count() == 2


def test_new_units_move_few_groups(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(3000)) for i in range(20_000)]
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    place = lambda rs: {x.group_id: x.split for x in components.assign(spark.createDataFrame(rs, "unit_id long, group_id long"), shares).select("group_id", "split").distinct().collect()}
    before, after = place(rows), place(rows + [(50_000 + i, r.randrange(3300)) for i in range(400)])
    assert sum(before[g] != after[g] for g in before) < 0.02 * len(before)


def test_huge_groups_leave_the_shares_near(spark):
    for big in ([6000], [3000, 2500], [1500, 1400, 1300, 1200]):
        sizes = big + [7] * 600
        rows = [(k * 10_000 + i, k) for k, n in enumerate(sizes) for i in range(n)]
        got = components.assign(spark.createDataFrame(rows, "unit_id long, group_id long"), {"train": 0.7, "validation": 0.15, "test": 0.15}).toPandas()
        assert got.groupby("group_id").split.nunique().max() == 1
        assert abs((got.split == "train").mean() - 0.7) < 0.01 and abs((got.split == "test").mean() - 0.15) < 0.01
