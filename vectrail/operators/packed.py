"""Several values packed in one field, unpacked to one row per value.

The field is cut at its quote characters.  Pieces between a pair of quotes are
literals; the rest are cut into words at whatever is not a word character.  A
SQL array fold walks over the cut pieces and puts values together in order, so
quoted delimiters, doubled quotes and backslashed quotes come back plain.  All
of it runs as built-in expressions inside the stage that reads the rows: the
unpacking itself shuffles nothing and uses no Python.

Defined results: null, empty and blank fields give no row; an empty pair of
quotes gives no row; an opening quote without a partner counts as a delimiter
and the text behind it as unquoted; repeated values are kept, each with its own
position; a row with a null key still gives its values, under a null key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces folded before their values are appended to those before.
BLOCK = 256
#: Cuts a field into backslashed quotes, single quote marks and runs of anything else.
_PIECES = r"""\\["']|["']|[^"'\\]+|\\"""


def _words(text: Column, extra: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{N}}.\-{extra}]+"), F.lit(0))


def packed_values(field: str | Column, underscore: bool = True) -> Column:
    """array<string> of the values packed in ``field``, in the order written."""
    text = F.col(field) if isinstance(field, str) else field
    extra = "_" if underscore else ""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    no = F.array().cast("array<string>")

    def state(q: Column, buf: Column, half: Column, out: Column) -> Column:
        return F.struct(q.alias("q"), buf.alias("buf"), half.alias("half"), out.alias("out"))

    none, yes, nope = F.lit(""), F.lit(True), F.lit(False)

    def literal(s: Column) -> Column:
        return F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"]))

    def step(s: Column, t: Column) -> Column:
        mark = t.isin('"', "'")

        def outside(out: Column) -> Column:
            return F.when(mark, state(t, none, nope, out)).otherwise(
                state(none, none, nope, F.concat(out, _words(t, extra)))
            )

        inside = (
            F.when(t == s["q"], state(s["q"], s["buf"], yes, s["out"]))
            .when(t.isin('\\"', "\\'"), state(s["q"], F.concat(s["buf"], F.substring(t, 2, 1)), nope, s["out"]))
            .otherwise(state(s["q"], F.concat(s["buf"], t), nope, s["out"]))
        )
        after_mark = F.when(t == s["q"], state(s["q"], F.concat(s["buf"], t), nope, s["out"])).otherwise(
            outside(literal(s))
        )
        return F.when(s["q"] == "", outside(s["out"])).when(s["half"], after_mark).otherwise(inside)

    def finish(s: Column) -> Column:
        return F.when(s["q"] == "", s["out"]).when(s["half"], literal(s)).otherwise(
            F.concat(s["out"], _words(s["buf"], extra))
        )

    # Pieces are folded block by block, and a block's values appended at once: a long field is not copied a piece at a time.
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces)), F.lit(BLOCK)), lambda i: F.slice(pieces, i, BLOCK))

    def block(s: Column, part: Column) -> Column:
        inner = F.array(F.aggregate(part, state(s["q"], s["buf"], s["half"], no), step))
        return F.transform(inner, lambda x: state(x["q"], x["buf"], x["half"], F.concat(s["out"], x["out"])))[0]

    folded = F.aggregate(parts, state(none, none, nope, no), block, finish)
    quoted = F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))
    # Without a quote character the fold has one piece at most; its words are then the result.
    return F.when(quoted, folded).otherwise(_words(text, extra))


def unpack(
    df: DataFrame,
    key: str,
    field: str,
    source: str,
    underscore: bool = True,
) -> DataFrame:
    """(source_table, row_id, pos, piece): one row per packed value of ``field``."""
    return (
        df.select(F.col(key).cast("long").alias("row_id"), F.posexplode(packed_values(field, underscore)).alias("pos", "piece"))
        .select(F.lit(source).alias("source_table"), "row_id", "pos", "piece")
    )


def unpack_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
