"""Change detection: inventories, records and children against their previous state.

All joins are equi-joins on a key; whether a side is broadcast is left to the optimizer, which knows the sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_hashes(now: DataFrame, prev: DataFrame, contents: DataFrame | None = None, trust_mtime: bool = True) -> DataFrame:
    """Inventory with hashes: the stored one where size and time agree, else that of the bytes.

    ``contents`` (path, content or raw_sha256) is read for the other paths only.
    """
    old = prev.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("raw_sha256").alias("_sha"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) if trust_mtime else F.lit(False)
    joined = now.drop("raw_sha256").join(old, "path", "left").withColumn("_reused", F.coalesce(same, F.lit(False)))
    kept = joined.where("_reused").withColumn("raw_sha256", F.col("_sha"))
    fresh = joined.where("NOT _reused")
    source = contents if contents is not None else now
    sha = F.sha2(F.col("content"), 256) if "content" in source.columns else F.col("raw_sha256")
    fresh = fresh.join(source.select("path", sha.alias("raw_sha256")), "path")
    cols = [*now.drop("raw_sha256").columns, "raw_sha256", F.col("_reused").alias("reused")]
    return kept.select(*cols).unionByName(fresh.select(*cols))


def dirty_groups(now: DataFrame, prev: DataFrame) -> DataFrame:
    """Groups (version_dir) with a new, changed or removed file; a removed or moved file also dirties its old group."""
    old = prev.select("path", F.col("version_dir").alias("_dir"), F.col("raw_sha256").alias("_sha"))
    both = now.select("path", "version_dir", "raw_sha256").join(old, "path", "full_outer")
    changed = both.where(~(F.col("raw_sha256").eqNullSafe(F.col("_sha")) & F.col("version_dir").eqNullSafe(F.col("_dir"))))
    return changed.select(F.explode(F.array_distinct(F.array_compact(F.array("version_dir", "_dir")))).alias("version_dir")).distinct()


def packed(child: Column) -> Column:
    """Bytes for a text: of one in lower-case hexadecimal, as hashes are, half as many; told apart by the first byte."""
    short = F.unhex(child)
    return F.when(F.lower(F.hex(short)) == child, F.concat(F.lit(b"\x01"), short)).otherwise(F.concat(F.lit(b"\x00"), child.cast("binary")))


def unpacked(data: Column) -> Column:
    rest = F.substring(data, F.lit(2), F.length(data))
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def gathered(children: DataFrame, owner: str, child: str, name: str) -> DataFrame:
    """owner, name: the packed distinct children of each owner."""
    return children.select(owner, packed(F.col(child)).alias(child)).groupBy(owner).agg(F.collect_set(child).alias(name))


def diff_records(new: DataFrame, old: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, change_kind (add, update, remove, noop), new_<c> and old_<c> for the compared columns."""
    a = new.select(key, F.lit(True).alias("_n"), *(F.col(c).alias(f"new_{c}") for c in compare))
    b = old.select(key, F.lit(True).alias("_o"), *(F.col(c).alias(f"old_{c}") for c in compare))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    kind = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "remove").when(same, "noop").otherwise("update")
    return a.join(b, key, "full_outer").select(key, kind.alias("change_kind"), *(f"{p}_{c}" for c in compare for p in ("new", "old")))


def added_children(new: DataFrame, old: DataFrame, owner: str, child: str) -> DataFrame:
    """Children (owner, child) of ``new`` that their owner did not have."""
    return new.select(owner, child).distinct().join(old.select(owner, child).distinct(), [owner, child], "left_anti")


def children_changed(new: DataFrame, old: DataFrame, owner: str, child: str) -> DataFrame:
    """owner, added, changed: any child added, or counts of distinct children differ, for owners in both."""
    both = new.select(owner, child).distinct().withColumn("n", F.lit(1)).join(old.select(owner, child).distinct().withColumn("o", F.lit(1)), [owner, child], "full_outer")
    counted = both.groupBy(owner).agg(F.count("n").alias("now"), F.count("o").alias("before"), F.count(F.when(F.col("o").isNull(), 1)).alias("added"))
    return counted.where("now > 0 AND before > 0").select(owner, "added", ((F.col("added") > 0) | (F.col("now") != F.col("before"))).alias("changed"))


def touched_packages(dirty: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Packages of dirty groups: from the new record and, where it is gone or renamed, the previous one."""
    n = new.select("version_dir", F.col("package_id").alias("_n"))
    o = old.select("version_dir", F.col("package_id").alias("_o"))
    joined = dirty.select("version_dir").join(n, "version_dir", "left").join(o, "version_dir", "left")
    return joined.select(F.explode(F.array_distinct(F.array_compact(F.array("_n", "_o")))).alias("package_id")).distinct()


def expand_siblings(touched: DataFrame, versions: DataFrame, computed: DataFrame) -> DataFrame:
    """Versions of touched packages that were not recomputed."""
    return versions.join(touched.select("package_id").distinct(), "package_id", "left_semi").join(computed.select("version_dir").distinct(), "version_dir", "left_anti")


def needs_backfill(current: DataFrame, versions: DataFrame, columns: list[str]) -> DataFrame:
    """Groups still present whose stored projection or children are null.

    A scan for each column, so that the test for null reaches the files: those whose statistics have no null are not read.
    """
    missing = reduce(DataFrame.unionByName, (versions.where(F.col(c).isNull()).select("version_dir") for c in columns))
    return missing.join(current.select("version_dir").distinct(), "version_dir", "left_semi").distinct()


def groups_to_refresh(dirty: DataFrame, current: DataFrame, everything: bool) -> DataFrame:
    """Dirty groups, and on a full rebuild every current one."""
    groups = dirty.select("version_dir")
    return groups.union(current.select("version_dir")).distinct() if everything else groups.distinct()


def still_present(groups: DataFrame, current: DataFrame) -> DataFrame:
    return groups.join(current.select("version_dir").distinct(), "version_dir", "left_semi")


def apply_changes(prev: DataFrame, computed: DataFrame, compared: DataFrame, key: str = "version_dir") -> DataFrame:
    """The state after a run: rows of compared keys are replaced by the computed ones, the rest stays."""
    kept = prev.join(compared.select(key).distinct(), key, "left_anti")
    return kept.unionByName(computed.select(*prev.columns), allowMissingColumns=False)


def validation_queue(changes: DataFrame, new_children: DataFrame, old_children: DataFrame, owner: str = "version_dir", child: str = "child_sha") -> DataFrame:
    """owner, child, reason: children of added records, and children that updated records gained; a null child is none.

    Everything is joined by owner, on lists of its packed children that are gathered as ``records.children_hash`` gathers
    them: where both are asked for, Spark shuffles the children once for both.
    """
    kinds = changes.where(F.col("change_kind").isin("add", "update")).select(owner, "change_kind")
    listed = lambda rows, name: gathered(rows, owner, child, name)
    joined = listed(new_children, "_now").join(kinds, owner).join(listed(old_children, "_had"), owner, "left")
    gained = F.when((F.col("change_kind") == "add") | F.col("_had").isNull(), F.col("_now")).otherwise(F.array_except("_now", "_had"))
    rows = joined.select(owner, "change_kind", F.explode(gained).alias(child))
    return rows.select(owner, unpacked(F.col(child)).alias(child), F.when(F.col("change_kind") == "add", "added").otherwise("installer-changed").alias("reason"))


def queue_order(queue: DataFrame, *columns: str) -> DataFrame:
    return queue.orderBy(*columns)


def diff_summary(changes: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: added, updated, removed, revalidations."""
    counts = changes.agg(*(F.count_if(F.col("change_kind") == k).alias(n) for k, n in (("add", "added"), ("update", "updated"), ("remove", "removed"))))
    return counts.crossJoin(queue.agg(F.count(F.lit(1)).alias("revalidations")))  # one row each
