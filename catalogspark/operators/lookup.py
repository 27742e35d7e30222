"""Questions to a catalogue: targets, package views, reverse lookup, build logs, retention and status."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_targets(versions: DataFrame, directories: list[str] = (), files: list[str] = (), packages: list[str] = (), package_version: tuple[str, str] | None = None) -> DataFrame:
    """version_dir of the wanted groups.  One kind of target at a time; an unknown or ambiguous (package, version) fails."""
    if sum(map(bool, (directories, files, packages, package_version))) > 1:
        raise ValueError("kinds of targets exclude each other")
    if directories:
        rows = versions.where(F.col("version_dir").isin(*directories))
    elif files:
        rows = versions.where(F.col("version_dir").isin(*{f.rpartition("/")[0] for f in files}))
    elif packages:
        rows = versions.where(F.col("package_id").isin(*packages))
    elif package_version:
        rows = versions.where((F.col("package_id") == package_version[0]) & (F.col("package_version") == package_version[1]))
        if (n := rows.select("version_dir").distinct().limit(2).count()) != 1:
            raise ValueError(f"{package_version} names {'no' if n == 0 else 'more than one'} version")
    else:
        rows = versions.limit(0)
    return rows.select("version_dir").distinct()


def exclude_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    return files.join(targets, "version_dir", "left_anti")


def package_detail(versions: DataFrame, packages: DataFrame | None = None, package_id: str | None = None) -> DataFrame:
    """package_id, the package's attributes if given, and its versions ordered by directory; of one package or of all."""
    rows = versions if package_id is None else versions.where(F.col("package_id") == package_id)
    out = rows.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("version_dir", "package_version", "channel"))).alias("versions"))
    return out if packages is None else packages.join(out, "package_id")


def find_child(children: DataFrame, hashes: list[str] | DataFrame, column: str = "child_sha") -> DataFrame:
    """Rows that hold one of the hashes (a list, or a table's first column), whatever its case; each once."""
    key = F.lower(column)
    if isinstance(hashes, list):
        return children.where(key.isin(*[h.lower() for h in hashes])).distinct()
    wanted = hashes.select(F.lower(hashes.columns[0]).alias("_hash")).distinct()
    return children.join(wanted, key == F.col("_hash"), "left_semi").distinct()


def list_builds(builds: DataFrame, statuses: list[str] = (), limit: int | None = None) -> DataFrame:
    """Newest first; ``staged`` also means ``staged_reused``; the filter comes before the limit."""
    wanted = {*statuses} | ({"staged_reused"} if "staged" in statuses else set())
    rows = builds.where(F.col("status").isin(*sorted(wanted))) if wanted else builds
    rows = rows.orderBy(F.desc("build_id"))
    return rows if limit is None else rows.limit(limit)


def hash_report(versions: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Hash of each version and of its group's content, for all or some groups."""
    rows = versions if targets is None else versions.join(targets, "version_dir", "left_semi")
    return rows.select("package_id", "version_dir", "content_sha", F.sha2(F.concat_ws("|", "package_id", "package_version", "channel", "content_sha"), 256).alias("record_sha"))


def parse_age(text: str) -> timedelta:
    """``7d``, ``12h``, ``30m``, ``45s``, ``2w``."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]])


def age_cutoff(now: int | Column, age: str) -> Column:
    """Unix seconds of the moment that lies ``age`` before ``now``."""
    return (now if isinstance(now, Column) else F.lit(now)) - F.lit(int(parse_age(age).total_seconds()))


def prune_builds(builds: DataFrame, keep_last: int, older_than: int | Column | None = None) -> DataFrame:
    """Builds to delete: all but the newest ``keep_last``, if given only those that ended before ``older_than`` (unix seconds)."""
    ranked = builds.join(builds.select("build_id").orderBy(F.desc("build_id")).limit(keep_last), "build_id", "left_anti")
    if older_than is None:
        return ranked
    cutoff = older_than if isinstance(older_than, Column) else F.lit(older_than)
    return ranked.where(F.coalesce("finished", "started") < cutoff)


def current_builds(events: DataFrame) -> DataFrame:
    """Latest event of every build."""
    return events.groupBy("build_id").agg(F.max_by(F.struct("status", "at_s"), F.struct("at_s", "seq")).alias("e")).select("build_id", "e.status", "e.at_s")


def pointers(builds: DataFrame) -> DataFrame:
    """The newest staged and the newest published build."""
    kind = F.when(F.col("status").isin("staged", "staged_reused"), "staged").when(F.col("status") == "published", "published")
    return builds.select(kind.alias("pointer"), "build_id").where("pointer IS NOT NULL").groupBy("pointer").agg(F.max("build_id").alias("build_id"))


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each state table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
