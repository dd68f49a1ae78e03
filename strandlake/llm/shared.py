"""What the operators of this subpackage have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.staging import clear_staged, shared_folder, staged  # noqa: F401

#: White space is these six characters everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it.

    A column that a lambda refers to is computed again for each element; a lambda's
    own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: A key with more rows than this, and than the HOT_KEYS-th part of all, is hot; so there are never more than HOT_KEYS hot ones.
HOT_ROWS = 1 << 16
HOT_KEYS = 50_000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """left joined with right by a key that right has once, without its column `rows`: how many rows of left have the key.

    The few hot keys, of a number that is bounded, are sent to all tasks, so that none
    gathers the rows of one. Both tables should be staged. how may be inner or left.
    """
    found = right.agg(F.max(rows), F.sum(rows)).first()
    bound = max(HOT_ROWS if hot_rows is None else hot_rows, (found[1] or 0) // HOT_KEYS)
    if not found[0] or found[0] <= bound:
        return left.join(right.drop(rows), key, how)
    hot = right.filter(F.col(rows) > bound).drop(rows)
    few = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(rows) <= bound).drop(rows), key, how)
    return few.unionByName(rest)


def words(text: Column) -> Column:
    """The words of a text, an empty array if it has none."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
