"""Search index tables: dictionaries, bridges, inverted tables, the path tree and the star fact."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.operators.rollup import rank_versions
from catalogspark.sources.scratch import written


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """value, id: dense ids from 1 in order of value, without a window over everything.

    Values are dealt to ranges and numbered inside each; the ranges' sizes, one row for each partition, give the
    offsets.  The ranged rows are a written table, because range bounds are sampled and a second run could differ.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.select(value).where(F.col(value).isNotNull()).distinct().repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "dictionary")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(value))
    return ranged.withColumn("_nth", inside).join(F.broadcast(offsets), "_part").select(value, (F.col("_before") + F.col("_nth")).cast("long").alias("id"))


def map_table(df: DataFrame, owner: str, value: str, words: DataFrame) -> DataFrame:
    """owner, id: distinct pairs of an owner and the id of its value."""
    return df.select(owner, value).where(F.col(value).isNotNull()).distinct().join(words, value).select(owner, "id")


def inverted_table(df: DataFrame, owner: str, value: str) -> DataFrame:
    """value, owner: distinct."""
    return df.select(value, owner).where(F.col(value).isNotNull()).distinct()


def path_tree(df: DataFrame, path: str) -> DataFrame:
    """id, parent (null at the top), name, path: a node for every distinct prefix."""
    parts = F.split(F.col(path), "/")
    nodes = df.select(path).distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    ids = dictionary(nodes, "path")
    up = ids.select(F.col("path").alias("_up"), F.col("id").alias("parent"))
    named = ids.withColumn("_up", F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.join(up, "_up", "left").select("id", "parent", "name", "path")


def fact_table(versions: DataFrame, dicts: dict[str, DataFrame]) -> DataFrame:
    """One row for each version with the ids of its values; dicts: column -> dictionary (column, id)."""
    out = rank_versions(versions)
    for column, words in dicts.items():
        out = out.join(words.withColumnRenamed("id", f"{column}_ref"), column, "left")
    return out.select("version_dir", "ordinal", *(f"{c}_ref" for c in dicts))


def metadata_rows(versions: DataFrame, owner: str, attributes: dict[int, str]) -> DataFrame:
    """owner, kind, value: a row for each optional attribute that is set; attributes: kind number -> column."""
    items = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in attributes.items()))
    return versions.select(owner, F.explode(items).alias("m")).where("m.value IS NOT NULL").select(owner, "m.kind", "m.value")


def index_metadata(versions: DataFrame, fmt: int, now: int, base: int) -> DataFrame:
    """Key/value rows of an index: schema version, last write, tracking base (0 at least), rows it covers."""
    items = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in (("majorVersion", fmt), ("lastWriteTime", now), ("trackingBase", max(0, base)))))
    count = F.array(F.struct(F.lit("rows").alias("name"), F.col("n").cast("string").alias("value")))
    return versions.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.concat(items, count)).alias("m")).select("m.name", "m.value")


def index_lookup(words: DataFrame, bridge: DataFrame, value: str, owner: str) -> DataFrame:
    """Back from ids to values: value, owner."""
    return bridge.join(words, "id").select(value, owner)


def counted(words: DataFrame, bridge: DataFrame) -> DataFrame:
    """value, id, n: a dictionary with the number of owners of each value, by which it is kept up to date."""
    return words.join(bridge.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id").select("value", "id", "n")


def changed_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """package, value, sign: pairs that some owners have gained (1) or lost (-1); a pair that is given twice counts once."""
    both = before.select("package", "value").distinct().withColumn("s", F.lit(-1)).unionByName(after.select("package", "value").distinct().withColumn("s", F.lit(1)))
    return both.where("package IS NOT NULL AND value IS NOT NULL").groupBy("package", "value").agg(F.sum("s").cast("int").alias("sign")).where("sign <> 0")


def update_words(words: DataFrame, changes: DataFrame, first: int) -> dict[str, DataFrame]:
    """What the pairs that were gained and lost change of a dictionary (value, id, n) and of its bridge (package, id).

    Ids stay; new values get ids from ``first`` on, in order; a value goes when its last owner goes, and its id is not given
    again.  words, words_gone, bridge, bridge_gone, fresh (the new values).  Null owners and values are no pairs.
    """
    by_value = changes.groupBy("value").agg(F.sum("sign").alias("d"))
    known = words.select("value", "id", "n").join(by_value, "value")
    fresh = dictionary(by_value.join(known.select("value"), "value", "left_anti"), "value").withColumn("id", F.col("id") + F.lit(first - 1))
    fresh = fresh.join(by_value, "value").select("value", "id", F.col("d").alias("n"))
    moved = known.where("d <> 0").select("value", "id", (F.col("n") + F.col("d")).alias("n"))
    ids = known.select("value", "id").unionByName(fresh.select("value", "id"))
    pairs = changes.join(ids, "value")
    return {
        "words": moved.where("n > 0").unionByName(fresh), "words_gone": moved.where("n <= 0"),
        "bridge": pairs.where("sign > 0").select("package", "id"), "bridge_gone": pairs.where("sign < 0").select("package", "id"), "fresh": fresh,
    }


#: Tables of the two index formats (fixed values): dictionary and bridge, dictionary alone, values with their owners.
V2_MAPPED, V2_DIRECT = ("tags", "commands"), ("pfns", "productcodes", "upgradecodes", "norm_names", "norm_publishers")
V1_SCALARS = ("ids", "names", "monikers", "versions", "channels")
V1_MAPPED = ("tags", "commands", "pfns", "productcodes", "norm_names", "norm_publishers")
PUBLISHER_KIND = 5


class Tables(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self):
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._makers[name] = make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def build_index_v2(packages: DataFrame, values: dict[str, DataFrame], owners: DataFrame | None = None, now: int = 0, base: int = 0) -> Tables:
    """The package-level index: 11 tables.  packages: one row each; values: name -> (package_id, value).

    ``owners`` (package_id) may come from a cheaper table than ``packages``; it must hold the same packages.
    """
    out, helper = Tables(), Tables()
    helper.add("ids", lambda: dictionary(packages if owners is None else owners, "package_id").withColumnRenamed("id", "package"))
    none = packages.limit(0).select("package_id", F.lit(None).cast("string").alias("value"))
    out.add("packages", lambda: packages.join(helper["ids"], "package_id"))
    out.add("metadata", lambda: index_metadata(packages, 2, now, base))
    owned = lambda n: values.get(n, none).join(helper["ids"], "package_id")
    for name in V2_MAPPED:
        out.add(f"{name}2", lambda n=name: dictionary(values.get(n, none), "value"))
        out.add(f"{name}2_map", lambda n=name: map_table(owned(n), "package", "value", out[f"{n}2"]))
    for name in V2_DIRECT:
        out.add(f"{name}2", lambda n=name: inverted_table(owned(n), "package", "value"))
    return out


def build_index_v1(versions: DataFrame, values: dict[str, DataFrame], now: int = 0, base: int = 0) -> Tables:
    """The version-level star schema: 21 tables.

    versions: version_dir, package_id, package_version, channel, name (falls back to the id), moniker, publisher, path;
    values: name -> (version_dir, value).
    """
    rows = versions.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "package_id"))
    columns = dict(zip(V1_SCALARS, ("package_id", "name", "moniker", "package_version", "channel"), strict=True))
    out = Tables()
    for table, column in columns.items():
        out.add(table, lambda c=column: dictionary(rows, c))
    out.add("pathparts", lambda: path_tree(rows, "path"))
    out.add("metadata", lambda: index_metadata(rows, 1, now, base))
    out.add("manifest_metadata", lambda: metadata_rows(rows, "version_dir", {PUBLISHER_KIND: "publisher"}))
    out.add("manifest", lambda: fact_table(rows, {c: out[t] for t, c in columns.items()} | {"path": out["pathparts"].select("path", "id")}))
    none = rows.limit(0).select("version_dir", F.lit(None).cast("string").alias("value"))
    for name in V1_MAPPED:
        out.add(name, lambda n=name: dictionary(values.get(n, none), "value"))
        out.add(f"{name}_map", lambda n=name: map_table(values.get(n, none), "version_dir", "value", out[n]))
    return out
