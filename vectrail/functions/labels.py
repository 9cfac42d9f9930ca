"""Perturbation labels, dataset ids and reference keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that stand for a missing label, and the label words that name no target.
MISSING_LABELS = ["", "na", "nan", "none", "<na>", "unknown", "null"]
COMBINATION_EXCLUDE = ["MULTI_TARGET"]
SINGLETON_TOKENS = ["only", "single", "singleton", "ctrl", "control", "neg", "negative"]
PREFIX_TOKENS = ["tcrlibrary", "library", "grna", "sgrna"]
CONTROL_LABELS = ["control", "NT", "WT", "MULTI_TARGET"]

#: Full-width forms of the printable ASCII characters, and those characters.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain_lower(x: str | Column) -> Column:
    """Lower case, full-width forms as plain ones; texts of one byte a letter hold none and are spared the look-up."""
    x = _col(x)
    return F.lower(F.when(F.octet_length(x) > F.char_length(x), F.translate(x, _WIDE, _PLAIN)).otherwise(x))


def normalize_label(x: str | Column) -> Column:
    """Trimmed text, or null where it is one of the words for a missing label."""
    text = F.trim(_col(x))
    return F.when(~F.lower(text).isin(MISSING_LABELS), text)


def is_combination(x: str | Column) -> Column:
    """True where a label names two or more targets, by the split builder's rules."""
    label = normalize_label(x)
    ignored = SINGLETON_TOKENS + PREFIX_TOKENS
    token = lambda t: (
        (t != "") & ~F.lower(t).isin(ignored) & ~F.lower(t).rlike("^pmj[0-9]+$") & ~t.rlike("^[0-9]+$")
    )
    named = F.size(F.filter(F.split(label, "_"), token))
    return (
        F.when(label.isNull() | label.isin(COMBINATION_EXCLUDE), F.lit(False))
        .when(label.rlike(r"[+,;|]"), F.lit(True))
        .when(~F.contains(label, F.lit("_")), F.lit(False))
        .otherwise(named >= 2)
    )


def components(x: str | Column) -> Column:
    """Parts of a combination label by the baselines' rules; no part for controls and single labels."""
    label = _col(x)
    none = F.array().cast("array<string>")
    return F.when(
        label.isNull() | (label == "") | label.isin(CONTROL_LABELS) | ~F.contains(label, F.lit("_")), none
    ).otherwise(F.filter(F.split(label, "_"), lambda t: t != ""))


def dataset_key(x: str | Column) -> Column:
    """A dataset id without its typography: case, separators, file suffix, leading zeros."""
    text = F.regexp_replace(plain_lower(x), r"\.h5ad[^\p{L}\p{N}]*$", "")
    text = F.regexp_replace(text, r"(?<![0-9])0+(?=[0-9])", "")
    key = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key)


def reference_key(x: str | Column) -> Column:
    """A reference key as its runs of letters and of digits, without leading zeros."""
    runs = F.regexp_extract_all(plain_lower(x), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    key = F.array_join(F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(?=[0-9])", "")), "-")
    return F.when(~key.isin(MISSING_LABELS), key)


def targets(x: str | Column) -> Column:
    """array<struct<stem, num>>: the targets a label names, however it is typed.

    ``stem`` holds the letters, ``num`` the closing number without leading zeros
    ('' if none).  Words that name nothing new are left out.
    """
    tokens = F.regexp_extract_all(plain_lower(x), F.lit(r"[\p{L}\p{N}]+(?:[-.][0-9]+(?![\p{L}\p{N}]))?"), F.lit(0))
    ignored = SINGLETON_TOKENS + PREFIX_TOKENS + MISSING_LABELS
    named = F.filter(tokens, lambda t: ~t.isin(ignored) & ~t.rlike(r"^(pmj)?[0-9.\-]+$"))
    return F.array_distinct(
        F.transform(
            named,
            lambda t: F.struct(
                F.regexp_replace(t, r"[-.]?[0-9]+$", "").alias("stem"),
                F.regexp_replace(F.regexp_extract(t, r"([0-9]+)$", 1), r"^0+(?=[0-9])", "").alias("num"),
            ),
        )
    )


def one_slip(x: str | Column, y: str | Column) -> Column:
    """True where two spellings differ by one letter changed, dropped or added, or by two neighbours swapped.

    A digit is no letter: spellings whose digits differ are not one slip apart.
    """
    x, y = _col(x), _col(y)
    first = F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), True).cast("int")
    swapped = F.concat(F.substring(x, F.lit(1), first - 1), F.substring(x, first + 1, F.lit(1)), F.substring(x, first, F.lit(1)), F.substring(x, first + 2, F.length(x))) == y
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    near = (F.levenshtein(x, y, 1) >= 0) | ((F.length(x) == F.length(y)) & (first > 0) & swapped)
    return (digits(x) == digits(y)) & near


def spelling_repairs(stems: DataFrame, shortest: int = 3) -> DataFrame:
    """(stem, repaired) for stems that are one slip away from a better attested stem.

    ``stems`` has (stem, n).  A slip is one letter changed, dropped, added or two
    neighbours swapped.  Candidates meet on their one-letter deletions, so no two
    stems are compared that share none; a stem gives as many rows as it has
    letters.  Stems shorter than ``shortest`` letters are never repaired.  A stem
    seen more than twice is repaired only towards one seen eight times as often.
    """
    known = stems.where(F.length("stem") >= shortest).select("stem", "n")
    cuts = F.transform(
        F.sequence(F.lit(1), F.length("stem")),
        lambda i: F.concat(F.substring("stem", F.lit(1), i - 1), F.substring(F.col("stem"), i + 1, F.length("stem"))),
    )
    keyed = known.withColumn("key", F.explode(F.array_distinct(F.array_append(cuts, F.col("stem")))))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = (
        a.join(b, F.col("a.key") == F.col("b.key"))
        .where(
            (F.col("a.stem") != F.col("b.stem"))
            & ((F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.stem") < F.col("a.stem"))))
            & ((F.col("a.n") <= 2) | (F.col("b.n") >= 8 * F.col("a.n")))
        )
        .select(F.col("a.stem").alias("stem"), F.col("b.stem").alias("other"), F.col("b.n").alias("n"))
    )
    near = pairs.where(one_slip("stem", "other"))
    best = Window.partitionBy("stem").orderBy(F.col("n").desc(), F.col("other"))
    return near.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("stem", F.col("other").alias("repaired"))


def canonical_targets(labels: DataFrame, label: str = "label", weight: str = "n") -> DataFrame:
    """(label, names): the sorted distinct target names of each of the distinct ``labels``.

    ``weight`` says how often a label occurs; it decides which spelling of a
    target is the attested one.
    """
    parts = labels.select(label, weight, F.explode(targets(label)).alias("t")).select(
        label, weight, F.col("t.stem").alias("stem"), F.col("t.num").alias("num")
    )
    repairs = spelling_repairs(parts.groupBy("stem").agg(F.sum(weight).alias("n")))
    return (
        parts.join(repairs, "stem", "left")
        .groupBy(label)
        .agg(F.array_sort(F.collect_set(F.concat(F.coalesce("repaired", "stem"), F.col("num")))).alias("names"))
    )
