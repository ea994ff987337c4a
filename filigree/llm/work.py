"""Helpers shared by the operators: shared work folder, tables, let-bindings, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written as stored

__all__ = ["BLANKS", "BLANK_RUN", "fresh", "let", "others", "range_parts", "read", "stored", "words_of"]

#: A word is a run of anything but these six white-space characters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def others(df: DataFrame, *replaced: str) -> list[Column]:
    """All columns of ``df`` but the replaced ones, by names that Spark takes as equal."""
    gone = {r.lower() for r in replaced}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` bears."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An outer expression that is named in a lambda is evaluated again for each element; a lambda
    variable isn't. So the value is bound as the variable of a transform of one element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null and for texts without a word."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)),
    )


def range_parts(df: DataFrame, size: int, part: int) -> int:
    """Partitions of a range shuffle of ``size`` units, ``part`` units each; no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
