"""Held-out passages inside training texts, by greedy string tiling.

Documents and held-out items are joined on shared runs of ``SEED`` tokens.  Each
pair that shares as many as any passage that counts must share is tiled: running
Karp-Rabin hashes find runs common to both, the longest are marked first and never
overlap.  An item leaks where some stretch of at least ``LEAST`` of its words is
covered with no more than one word in ``RATE`` changed, dropped or added between
its tiles, or where tiles of at least ``SEED`` tokens cover ``COVERED`` of its words
in whatever order they stand.

A word is an unbroken run of signs, so that a hyphenated word counts once.

Every document is read once and whole, in the scan's own partitions.  A bit table
of the items' runs, of fixed size whatever their number, goes to the executors and
drops documents that can't share enough; the runs of the others are joined with
the items' runs, and only pairs that met are tiled.

Defined results: null and empty texts and items give no row; an item shorter
than ``LEAST`` words can't leak; copies of a document each give a row; an item
given twice under two ids leaks under both.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.text import joined_words
from vectrail.session import scratch

SEED = 4
TILE = 3
LEAST = 15
RATE = 8
COVERED = 0.8
#: Bits of the table of runs that documents are held against before the join: 2 MB.
BITS = 24
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def shared_runs(least: int, rate: float, seed: int = SEED) -> int:
    """Runs of ``seed`` words that a stretch of at least ``least`` words keeps whatever one word in ``rate`` is changed.

    A change spoils ``seed`` runs at most; the fewest are left in the shortest stretch, or where another change is allowed.
    """
    lengths = [least, *(int(np.ceil(k * rate - 1e-9)) for k in range(1, int(4 * least / rate) + 8))]
    left = min(n - seed + 1 - seed * int(n / rate + 1e-9) for n in lengths if n >= least)
    if left < 1:
        raise ValueError(f"a stretch of {least} words with one in {rate} changed need not hold {seed} words in a row")
    return left


def _rolling(tokens: list[int], n: int) -> list[int]:
    """Karp-Rabin hashes of all runs of ``n`` tokens, each from the one before."""
    if len(tokens) < n:
        return []
    top = pow(_BASE, n, _MOD)
    h = 0
    for t in tokens[:n]:
        h = (h * _BASE + t) % _MOD
    out = [h]
    for i in range(n, len(tokens)):
        h = (h * _BASE + tokens[i] - top * tokens[i - n]) % _MOD
        out.append(h)
    return out


def tiles(doc: list[int], item: list[int], shortest: int = TILE) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the greedy tiling, sorted by place in the doc."""
    at = defaultdict(list)
    for j, h in enumerate(_rolling(item, shortest)):
        at[h].append(j)
    runs = []
    done = set()
    for i, h in enumerate(_rolling(doc, shortest)):
        for j in at.get(h, ()):
            if (i - 1, j - 1) in done:
                done.add((i, j))
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n >= shortest:
                done.add((i, j))
                runs.append((n, i, j))
    marked_doc, marked_item = bytearray(len(doc)), bytearray(len(item))
    found = []
    runs.sort(key=lambda r: (-r[0], r[1], r[2]))
    while runs:
        rest = []
        for n, i, j in runs:
            # What earlier, longer tiles left of this run.
            a = 0
            while a < n:
                while a < n and (marked_doc[i + a] or marked_item[j + a]):
                    a += 1
                b = a
                while b < n and not (marked_doc[i + b] or marked_item[j + b]):
                    b += 1
                if b - a == n:
                    marked_doc[i : i + n] = b"\x01" * n
                    marked_item[j : j + n] = b"\x01" * n
                    found.append((i, j, n))
                elif b - a >= shortest:
                    rest.append((b - a, i + a, j + a))
                a = b
        runs = sorted(rest, key=lambda r: (-r[0], r[1], r[2]))
    return sorted(found)


def _distance(a: list, b: list) -> int:
    """Least number of words changed, dropped or added between two short runs."""
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


class Text:
    """The tokens of a text, and the number of the written word that each of them is part of."""

    def __init__(self, tokens: list[int], word: list[int]):
        self.tokens, self.word = tokens, word

    def __len__(self) -> int:
        return len(self.tokens)

    def words(self, start: int, end: int) -> list[tuple[int, ...]]:
        return [tuple(t for t, _ in g) for _, g in groupby(zip(self.tokens[start:end], self.word[start:end]), key=lambda p: p[1])]

    def span(self, start: int, end: int) -> int:
        return self.word[end - 1] - self.word[start] + 1 if end > start else 0

    def part(self, start: int, end: int) -> Text:
        return Text(self.tokens[start:end], self.word[start:end])

    @classmethod
    def of(cls, text: str) -> Text:
        return cls.unpack(pack(text))

    @classmethod
    def unpack(cls, packed: np.ndarray) -> Text:
        return cls((packed >> 1).tolist(), np.cumsum(packed & 1).tolist())


class _Hashes(dict):
    """Hashes of words seen before; emptied when it has grown large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = out = crc32(w.encode())
        return out


def pack(text: str, hashes_of: _Hashes | None = None) -> np.ndarray:
    """A text's tokens as hashes of its words, the lowest bit telling where a written word begins."""
    words, number = joined_words(text)
    hashes_of = _Hashes() if hashes_of is None else hashes_of
    hashes = np.array([hashes_of[w] for w in words], np.int64)
    return (hashes & ~np.int64(1)) | (np.diff(np.array(number, np.int64), prepend=-1) != 0)


def runs(packed: np.ndarray) -> np.ndarray:
    """A hash of every run of ``SEED`` tokens."""
    toks = (packed >> 1).astype(np.uint64)
    n = len(toks) - SEED + 1
    h = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED if n > 0 else 0):
            h = h * np.uint64(0x100000001B3) + toks[k : k + n]
            h ^= h >> np.uint64(31)
            h = h * np.uint64(0x9E3779B97F4A7C15)
    return h


def _extend(doc: Text, item: Text, i: int, j: int, step: int, most: int) -> Iterator[tuple[int, int]]:
    """(item tokens gained, words changed) when a stretch goes on past one change after another."""
    gained = errors = 0
    inside = lambda i, j: 0 <= i < len(doc) and 0 <= j < len(item)
    skipped = lambda text, at, d: len({text.word[at + k * step] for k in range(1, d + 1)})
    while errors < most:
        best = (0, 0, 0, 99)
        for di, dj in ((1, 1), (0, 1), (1, 0), (2, 1), (1, 2), (2, 2)):
            n, x, y = 0, i + (di + 1) * step, j + (dj + 1) * step
            while inside(x, y) and doc.tokens[x] == item.tokens[y]:
                n, x, y = n + 1, x + step, y + step
            if n and n - max(di, dj) > best[0] - best[3]:
                best = (n, di, dj, max(di, dj))
        if not best[0]:
            return
        n, di, dj, _ = best
        errors += max(skipped(doc, i, di), skipped(item, j, dj))
        i, j, gained = i + (di + n) * step, j + (dj + n) * step, gained + dj + n
        yield gained, errors


def leaks(doc: Text, item: Text, least: int = LEAST, rate: float = RATE) -> tuple[int, int]:
    """The longest stretch of item words the doc repeats closely enough (0 if none is long enough), and the words under its tiles."""
    marked = tiles(doc.tokens, item.tokens)
    longest = 0
    most = int(item.span(0, len(item)) / rate) + 1  # no stretch of the item may have more changes
    limit = lambda span, errors: span >= least and errors <= span / rate + 1e-9
    for s in range(len(marked)):
        i0, j0, n0 = marked[s]
        i, j, errors = i0 + n0, j0 + n0, 0
        ends = [(i, j, 0)]
        for i1, j1, n1 in marked[s + 1 :]:
            if i1 >= i and doc.span(i, i1) > most + 1:
                break
            if i1 < i or j1 < j or item.span(j, j1) > most + 1:
                continue
            errors += _distance(doc.words(i, i1), item.words(j, j1))
            i, j = i1 + n1, j1 + n1
            ends.append((i, j, errors))
        for i, j, errors in ends:
            span = item.span(j0, j)
            if limit(span, errors):
                longest = max(longest, span)
            elif not longest and span >= least // 2:
                before = [(0, 0), *_extend(doc, item, i0, j0, -1, most)] if i0 and j0 else [(0, 0)]
                after = [(0, 0), *_extend(doc, item, i - 1, j - 1, 1, most)]
                for g0, e0 in before:
                    for g1, e1 in after:
                        span = item.span(j0 - g0, j + g1)
                        if limit(span, errors + e0 + e1):
                            longest = max(longest, span)
    return longest, len({item.word[k] for _, j, n in marked if n >= SEED for k in range(j, j + n)})


def compare(doc: np.ndarray, item: np.ndarray, least: int = LEAST, rate: float = RATE, covered: float = COVERED) -> int:
    """How many words of the packed ``item`` the packed ``doc`` repeats, in one stretch or in parts; 0 if it doesn't leak.

    Only the parts of the document near runs that it shares with the item are tiled.
    """
    at = np.flatnonzero(np.isin(runs(doc), runs(item)))
    if not len(at):
        return 0
    whole = Text.unpack(item)
    size = whole.span(0, len(whole))
    if size < least:
        return 0
    margin = 2 * len(item)
    longest = under = 0
    for near in np.split(at, np.flatnonzero(np.diff(at) > margin) + 1):
        part = doc[max(0, near[0] - margin) : near[-1] + SEED + margin]
        stretch, tiled = leaks(Text.unpack(part), whole, least, rate)
        longest, under = max(longest, stretch), max(under, tiled)
    return longest or (under if under >= max(least, covered * size) else 0)


def _read(df: DataFrame, key: str, text: str, table: np.ndarray | None, need: int) -> DataFrame:
    """(k, toks, seeds): packed texts with the hashes of their runs; those of ``table`` only, each once, if it is given."""
    kind = dict(df.dtypes)[key]
    sent = df.sparkSession.sparkContext.broadcast(table) if table is not None else None  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows, toks, seeds = [], [], []
            for r, body in enumerate(batch.column(1).to_pylist()):
                packed = pack(body, known)
                h = runs(packed)
                if sent is not None:
                    spot = h & np.uint64((1 << BITS) - 1)
                    h = h[(sent.value[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
                    if len(h) < need:
                        continue
                    h = np.unique(h)
                rows.append(r), toks.append(packed), seeds.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(toks, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
                names=["k", "toks", "seeds"],
            )

    narrow = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    return narrow.mapInArrow(run, f"k {kind}, toks array<long>, seeds array<long>").withColumn("row", F.monotonically_increasing_id())


def _table(items: DataFrame) -> np.ndarray:
    """A bit for each hash of the items' runs, by its lowest ``BITS`` bits."""
    spot = F.explode("seeds").alias("h")
    bits = items.select(spot).select((F.col("h").bitwiseAND((1 << BITS) - 1)).alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")
    )
    table = np.zeros(1 << (BITS - 6), np.uint64)
    for at, b in bits.collect():  # as many rows as the table has words, at most
        table[at] = np.uint64(b & (1 << 64) - 1)
    return table


def find_leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, rate: float = RATE, covered: float = COVERED
) -> DataFrame:
    """(key, item_key, n_words): the items each document repeats, wholly or in part."""
    need = shared_runs(least, rate)
    said = scratch(_read(items, item_key, item_text, None, 0))
    read = scratch(_read(docs, key, text, _table(said), need))
    seeds = said.select(F.col("row").alias("q"), F.explode("seeds").alias("seed")).groupBy("q", "seed").agg(F.count(F.lit(1)).alias("c"))
    met = (
        read.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
        .groupBy("row", "q").agg(F.sum("c").alias("c")).where(F.col("c") >= need).select("row", "q")
    )
    pairs = met.join(read.select("row", F.col("k"), "toks"), "row").join(
        said.select(F.col("row").alias("q"), F.col("k").alias("i"), F.col("toks").alias("item")), "q"
    )
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [compare(np.array(d, np.int64), np.array(i, np.int64), least, rate, covered) for d, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.int32())], names=["k", "i", "n_words"])
            yield out.filter(pa.array([s > 0 for s in spans], pa.bool_()))

    found = pairs.select("k", "i", "toks", "item").mapInArrow(run, f"k {kinds[0]}, i {kinds[1]}, n_words int")
    return found.select(F.col("k").alias(key), F.col("i").alias(item_key), "n_words")
