"""Per-package views: latest version, ordinals, set unions, package hashes and package changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions.version import version_key


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("package_id").agg(F.count(F.lit(1)).alias("version_count"))


def _order() -> list:
    return [F.col("channel").asc(), F.col("_key").desc(), F.col("version_dir").asc()]


def rank_versions(versions: DataFrame) -> DataFrame:
    """Ordinal (from 1) of every version in its package: channel up, version down, directory up."""
    ranked = versions.withColumn("_key", version_key(F.col("package_version")))
    return ranked.withColumn("ordinal", F.row_number().over(Window.partitionBy("package_id").orderBy(*_order())).cast("long")).drop("_key")


def latest_version(versions: DataFrame) -> DataFrame:
    """The first version of each package in that order; Spark drops all but the first of every task before the shuffle."""
    keyed = versions.withColumn("_key", version_key(F.col("package_version")))
    first = F.row_number().over(Window.partitionBy("package_id").orderBy(*_order()))
    return keyed.withColumn("_nth", first).where("_nth = 1").select("package_id", *[c for c in versions.columns if c != "package_id"])


def union_sets(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, values: sorted distinct values.  Duplicates go before values are gathered."""
    return rows.select(group, value).where(F.col(value).isNotNull()).distinct().groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"))


def rollup_packages(versions: DataFrame, attributes: dict[str, DataFrame]) -> DataFrame:
    """Latest version of each package with one sorted array per attribute; attributes: name -> (package_id, value)."""
    out = latest_version(versions)
    for name, rows in attributes.items():
        out = out.join(union_sets(rows, "package_id", "value").withColumnRenamed("values", name), "package_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def package_hash(versions: DataFrame) -> DataFrame:
    """package_id, package_sha: over the ordered list of version, channel and content hash."""
    ranked = rank_versions(versions)
    line = F.concat_ws("|", "package_version", "channel", "content_sha")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return ranked.groupBy("package_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256).alias("package_sha"))


def version_data(versions: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """package_id, versions: the ordered versions of each (touched) package, as sidecars hold them."""
    rows = versions if touched is None else versions.join(touched.select("package_id").distinct(), "package_id", "left_semi")
    item = F.struct("ordinal", "package_version", "channel", "version_dir", "content_sha")
    return rank_versions(rows).groupBy("package_id").agg(F.array_sort(F.collect_list(item)).alias("versions"))


def package_artifacts(fresh: DataFrame, previous: DataFrame, versions: DataFrame) -> DataFrame:
    """package_id, package_sha, carried: the fresh hash, else the previous one; a package with neither fails the job."""
    p = previous.select("package_id", F.col("package_sha").alias("_old"))
    rows = versions.select("package_id").distinct().join(fresh.select("package_id", "package_sha"), "package_id", "left").join(p, "package_id", "left")
    sha = F.coalesce("package_sha", "_old", F.raise_error(F.concat(F.lit("no artefact for package "), F.col("package_id"))))
    return rows.select("package_id", sha.alias("package_sha"), F.col("package_sha").isNull().alias("carried"))


def package_changes(new: DataFrame, old: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """package_id, change_kind, old_hash, new_hash, publish_changed, revalidate."""
    both = new.select("package_id", F.col("package_sha").alias("new_hash")).join(old.select("package_id", F.col("package_sha").alias("old_hash")), "package_id", "full_outer")
    flagged = flag_queue(both, queue) if queue is not None else both.withColumn("revalidate", F.lit(False))
    same = F.col("new_hash").eqNullSafe(F.col("old_hash"))
    kind = F.when(F.col("old_hash").isNull(), "add").when(F.col("new_hash").isNull(), "remove").when(same, "noop").otherwise("update")
    return flagged.select("package_id", kind.alias("change_kind"), "old_hash", "new_hash", (~same).alias("publish_changed"), "revalidate")


def flag_queue(packages: DataFrame, queue: DataFrame) -> DataFrame:
    """Adds ``revalidate``: whether the package has a row in the queue."""
    marks = queue.select("package_id").distinct().withColumn("revalidate", F.lit(True))
    return packages.join(marks, "package_id", "left").withColumn("revalidate", F.coalesce("revalidate", F.lit(False)))
