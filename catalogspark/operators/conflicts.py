"""Values of an attribute that several versions of one package claim, and who keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions.version import version_key

STRATEGIES = ("latest", "oldest", "strip-all", "error")
_OWNER = ("version_dir", "package_version", "channel")
_KEEPER = "struct<version_dir:string,package_version:string,channel:string>"


def claims(children: DataFrame) -> DataFrame:
    """Distinct claims (package_id, value, version_dir, package_version, channel)."""
    return children.select("package_id", "value", *_OWNER).where("value IS NOT NULL").distinct()


def find_conflicts(children: DataFrame) -> DataFrame:
    """package_id, value, claimants: values claimed by more than one version."""
    return winners(children, "strip-all").select("package_id", "value", "claimants")


def _marked(children: DataFrame, strategy: str, alone: Column | None = None) -> DataFrame:
    """Rows with ``_keeper`` (null under strip-all) and ``_fought``: whether several versions claim the value.

    Rows that are ``alone`` go through unfought, dealt by their versions, however many share a null.  One shuffle and one sort by package and value serve both windows; sort keys of versions are worked out for fought values only.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    group, owner, rows = Window.partitionBy("package_id", "value"), F.struct(*_OWNER), children
    if alone is not None:
        group, rows = Window.partitionBy("package_id", "value", "_apart"), rows.withColumn("_apart", F.when(alone, F.xxhash64(*_OWNER)))
    rows = rows.withColumns({"_least": F.min(owner).over(group), "_most": F.max(owner).over(group)})
    fought = ~F.col("_least").eqNullSafe(F.col("_most"))
    rows = rows.withColumn("_fought", fought if alone is None else fought & ~alone).drop("_least", "_most")
    key = F.when(F.col("_fought"), F.struct(version_key(F.col("package_version")).alias("v"), F.col("channel"), F.col("version_dir")))
    if strategy == "strip-all":
        return rows.withColumn("_keeper", F.lit(None).cast(_KEEPER))
    if strategy == "error":
        fail = F.raise_error(F.concat_ws(" ", F.lit("conflicting value"), "value", F.lit("in package"), "package_id"))
        return rows.withColumn("_keeper", F.when(F.col("_fought"), fail.cast(_KEEPER)))
    pick = F.max_by if strategy == "latest" else F.min_by
    return rows.withColumn("_keeper", pick(owner, key).over(group))


def _contenders(children: DataFrame, strategy: str) -> DataFrame:
    """Distinct claims to the values that several versions claim, with ``_keeper``."""
    return _marked(children.select("package_id", "value", *_OWNER).where("value IS NOT NULL"), strategy).where("_fought").drop("_fought").distinct()


def winners(children: DataFrame, strategy: str) -> DataFrame:
    """package_id, value, keeper (null under strip-all): greatest or least (version, channel, directory) of the claimants."""
    return _contenders(children, strategy).groupBy("package_id", "value").agg(F.count(F.lit(1)).alias("claimants"), F.first("_keeper").alias("keeper"))


def _loses() -> Column:
    kept = F.col("_keeper.version_dir")
    return kept.isNull() | (kept != F.col("version_dir"))


def losing_claims(children: DataFrame, strategy: str) -> DataFrame:
    """The claims to drop."""
    return _contenders(children, strategy).where("package_id IS NOT NULL").where(_loses()).drop("_keeper")


def resolve_conflicts(children: DataFrame, strategy: str = "latest") -> DataFrame:
    """Rows of ``children`` without the losing claims: one pass over them, one shuffle, no join."""
    marked = _marked(children, strategy, alone=F.col("package_id").isNull() | F.col("value").isNull())
    kept = marked.where(~F.col("_fought") | F.coalesce(F.col("_keeper.version_dir") == F.col("version_dir"), F.lit(False)))
    return kept.select(*children.columns)


def _label(version, channel):
    return F.when(channel == "", version).otherwise(F.concat(version, F.lit(" ["), channel, F.lit("]")))


def conflict_report(children: DataFrame, strategy: str = "latest") -> DataFrame:
    """package_id, value, retained, stripped: labels ``version [channel]``, the stripped ones sorted and joined by commas."""
    retained = _label(F.col("_keeper.package_version"), F.col("_keeper.channel"))
    lost = F.when(F.col("package_id").isNotNull() & _loses(), F.struct(_label(F.col("package_version"), F.col("channel")).alias("label")))
    g = _contenders(children, strategy).groupBy("package_id", "value").agg(F.first(retained).alias("retained"), F.array_sort(F.collect_list(lost)).alias("_lost"))
    return g.select("package_id", "value", "retained", F.when(F.size("_lost") > 0, F.array_join(F.transform("_lost", lambda x: x["label"]), ", ")).alias("stripped"))
