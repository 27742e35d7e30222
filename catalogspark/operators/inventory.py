"""Published and staged files: wanted paths, what to copy and delete, drift and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wanted_paths(records: DataFrame, sidecars: DataFrame, catalogue: str) -> DataFrame:
    """relpath: records, sidecars that are set, and the catalogue file."""
    last = records.sparkSession.range(1).select(F.lit(catalogue).alias("relpath"))
    return records.select("relpath").union(sidecars.where("relpath IS NOT NULL AND relpath <> ''").select("relpath")).union(last).distinct()


def published_inventory(records: DataFrame, sidecars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """relpath, kind, sha256 in order: records by path, sidecars by path, the catalogue last."""
    kinds = (("manifest", records), ("package", sidecars), ("catalog", catalogue))
    parts = [df.select("relpath", F.lit(k).alias("kind"), "sha256", F.lit(i).alias("_n")) for i, (k, df) in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("_n", "relpath").drop("_n")


def carry_forward(previous: DataFrame, wanted: DataFrame, changed: DataFrame) -> DataFrame:
    """Staged rows still wanted and not rewritten by this run."""
    return previous.join(changed.select("relpath").distinct(), "relpath", "left_anti").join(wanted.select("relpath").distinct(), "relpath", "left_semi")


def plan_publish(wanted: DataFrame, previous: DataFrame) -> DataFrame:
    """relpath, action: copy new or changed files, delete those no longer wanted."""
    both = wanted.select("relpath", F.col("sha256").alias("_w")).join(previous.select("relpath", F.col("sha256").alias("_p")), "relpath", "full_outer")
    action = F.when(F.col("_w").isNull(), "delete").when(~F.col("_w").eqNullSafe(F.col("_p")), "copy")
    return both.select("relpath", action.alias("action")).where("action IS NOT NULL")


def drift(tracked: DataFrame, actual: DataFrame) -> DataFrame:
    """relpath, drift_kind: missing (tracked, absent), mismatched (another hash), extra (present, not tracked)."""
    both = tracked.select("relpath", F.col("sha256").alias("_t"), F.lit(1).alias("_a")).join(actual.select("relpath", F.col("sha256").alias("_h"), F.lit(1).alias("_b")), "relpath", "full_outer")
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_t").eqNullSafe(F.col("_h")), "mismatched")
    return both.select("relpath", kind.alias("drift_kind")).where("drift_kind IS NOT NULL")


def verify_stage(expected: DataFrame, staged: DataFrame) -> DataFrame:
    """Expected paths that are not staged."""
    return expected.where("relpath IS NOT NULL AND relpath <> ''").select("relpath").distinct().join(staged.select("relpath").distinct(), "relpath", "left_anti")


def extra_files(tracked: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.select("relpath").distinct().join(tracked.select("relpath").distinct(), "relpath", "left_anti")
