"""Values of packages, counted by the versions that hold them: a version that goes takes back only what no other one holds.

The counts are a table of their own (package_id, attribute, value, n).  Versions that have changed move counts by what they
held before and hold now; other versions are not read, whatever their package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["package_id", "attribute", "value"]


def holdings(versions: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """package_id, version_dir, attribute, value: what each version holds, once; attributes: name -> column of arrays.

    Null packages, null arrays and null values hold nothing.
    """
    none = F.array().cast("array<string>")
    named = lambda name, column: F.transform(F.array_distinct(F.coalesce(column, none)), lambda v: F.struct(F.lit(name).alias("attribute"), v.alias("value")))
    items = F.concat(*(named(n, c) for n, c in attributes.items()))
    rows = versions.where("package_id IS NOT NULL").select("package_id", "version_dir", F.explode(items).alias("i"))
    return rows.select("package_id", "version_dir", "i.attribute", "i.value").where("value IS NOT NULL")


def count_holdings(rows: DataFrame) -> DataFrame:
    """package_id, attribute, value, n: by how many versions it is held.  ``rows`` holds each version's value once."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """package_id, attribute, value, d: by how much counts move when holdings of some versions change; what stays is left out.

    One aggregation, combined before the shuffle.  A version that moves to another package is gone from the first.
    """
    both = before.select(*KEY, F.lit(-1).alias("s")).unionByName(after.select(*KEY, F.lit(1).alias("s")))
    return both.groupBy(*KEY).agg(F.sum("s").alias("d")).where("d <> 0")


def moved_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """package_id, attribute, value, n, sign: the changed counts; sign is 1 for a value that its package has gained, -1 for
    one that it has lost (n is 0), 0 for one whose count alone has changed.

    Only changed keys are returned.  A count that would fall below 0 contradicts the table and fails the job.
    """
    joined = changes.join(counts.select(*KEY, F.col("n").alias("_n")), KEY, "left").withColumn("n", F.coalesce("_n", F.lit(0)) + F.col("d"))
    lacks = F.raise_error(F.concat(F.lit("a value is taken back that was not held by package "), F.col("package_id"))).cast("long")
    sign = F.when(F.col("_n").isNull(), 1).when(F.col("n") == 0, -1).otherwise(0)
    return joined.select(*KEY, F.when(F.col("n") >= 0, F.col("n")).otherwise(lacks).alias("n"), sign.alias("sign"))


def apply_moved(counts: DataFrame, moved: DataFrame) -> DataFrame:
    """The whole table after the changed counts."""
    return counts.join(moved.select(*KEY), KEY, "left_anti").unionByName(moved.where("n > 0").select(*counts.columns))


def apply_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """The whole table after ``count_changes``, for those who need no list of what has moved: one aggregation, no join.

    It contradicts itself where ``moved_counts`` does, and fails as that does.
    """
    both = counts.select(*KEY, F.col("n").cast("long").alias("n")).unionByName(changes.select(*KEY, F.col("d").cast("long").alias("n")))
    lacks = F.raise_error(F.concat(F.lit("a value is taken back that was not held by package "), F.col("package_id"))).cast("long")
    summed = both.groupBy(*KEY).agg(F.sum("n").alias("n"))
    return summed.where(F.when(F.col("n") < 0, lacks).otherwise(F.col("n")) > 0).select(*counts.columns)


def rollup_counted(counts: DataFrame, attributes: list[str]) -> DataFrame:
    """package_id and one sorted array for each attribute, empty where it has no value; packages without any value have no row.

    One shuffle for all attributes; each value is there once, so nothing has to be made distinct.
    """
    values = lambda a: F.array_sort(F.collect_list(F.when(F.col("attribute") == a, F.col("value"))))
    return counts.groupBy("package_id").agg(*(values(a).alias(a) for a in attributes))
