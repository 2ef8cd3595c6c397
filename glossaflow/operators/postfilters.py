"""Filters on recognised entities; each is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values. Words that with a number are no name, and other frequent false matches.
STOPWORDS = "a all and as at be for in is of on or per the to was cm kg ml mm mol μg μl μm μs ci d n hr max min p ph pi sp".split()
BAD = ["to a", "a 3d", ""]


def remove_overlaps(entities: DataFrame, keys: list[str], same_type: bool = False) -> DataFrame:
    """Of each chain of overlapping entities of a text the longest ones, all of equal length. Touching ones don't overlap. With ``same_type``, within each type."""
    by = [*keys, "type"] if same_type else keys
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    chained = entities.withColumn("__new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("__chain", F.sum("__new").over(upto))
    size = F.col("end") - F.col("start")
    longest = F.max(size).over(Window.partitionBy(*by, "__chain"))
    return chained.withColumn("__longest", longest).where(size == F.col("__longest")).drop("__new", "__chain", "__longest")


def remove_submatches(entities: DataFrame, keys: list[str], same_type: bool = False) -> DataFrame:
    """The entities that do not lie strictly within another of their text; equal spans stay. With ``same_type``, within each type.

    One pass over the distinct spans of a text by start and falling end: a span lies within one before it if that ends
    no earlier.
    """
    by = [*keys, "type"] if same_type else keys
    before = Window.partitionBy(*by).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = entities.select(*by, "start", "end").distinct().withColumn("__reach", F.max("end").over(before))
    outer = spans.where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end"))).drop("__reach")
    return entities.join(outer, [*by, "start", "end"], "left_semi")


def is_frequent_false(surface: Column) -> Column:
    """Whether a surface is a stopword with a number, a unit, a listed phrase or holds a comparison."""
    words = [*STOPWORDS, *[w.title() for w in STOPWORDS if len(w) > 1]]
    number = "^(?:" + "|".join(words) + r")[^\p{L}\p{N}_]+\p{Nd}+$"
    unit = r"^μ[A-Za-z](?:[^\p{L}\p{N}_]|\p{Nd})*$"
    return surface.rlike(number) | surface.rlike(unit) | F.lower(surface).isin(BAD) | surface.rlike("[<=>]")


def frequent_fp(entities: DataFrame) -> DataFrame:
    return entities.where(~is_frequent_false(F.col("text")))


def remove_short(entities: DataFrame, least: int = 3) -> DataFrame:
    return entities.where(F.length("text") >= least)


def change_origin(entities: DataFrame, origin: str) -> DataFrame:
    return entities.withColumn("original_resource", F.lit(origin))


BUILTIN: dict[str, Callable[..., DataFrame]] = {
    "remove_overlaps": remove_overlaps,
    "remove_sametype_overlaps": lambda e, keys: remove_overlaps(e, keys, True),
    "remove_submatches": remove_submatches,
    "remove_sametype_submatches": lambda e, keys: remove_submatches(e, keys, True),
    "frequentFP": lambda e, keys: frequent_fp(e),
}


def apply_filters(entities: DataFrame, filters: list, keys: list[str]) -> DataFrame:
    """``entities`` after some filters in sequence: names of BUILTIN, with or without 'builtin:', or functions of entities and keys."""
    return reduce(lambda e, f: (BUILTIN[f.removeprefix("builtin:")] if isinstance(f, str) else f)(e, keys), filters, entities)
