"""Records out of fragments: integrity rules, overlay, canonical text, projection and children."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import normalize as nz
from catalogspark.operators import diff
from catalogspark.sources.fragments import canonical, dump

# Fields every fragment has; root fields that describe and do not identify a child.
COMMON = ("PackageIdentifier", "PackageVersion", "ManifestVersion", "ManifestType")
DESCRIPTIVE = (
    "PackageLocale", "DefaultLocale", "Publisher", "PublisherUrl", "PublisherSupportUrl", "PrivacyUrl", "Author", "PackageName", "PackageUrl", "License", "LicenseUrl", "Copyright",
    "CopyrightUrl", "ShortDescription", "Description", "Tags", "Agreements", "Documentations", "ReleaseNotes", "ReleaseNotesUrl", "PurchaseUrl", "InstallationNotes", "Icons",
    "Localization", "ManifestVersion", "ManifestType", "Moniker", "ReleaseDate", "DisplayInstallWarnings",
)
IDENTITY = ("PackageIdentifier", "PackageVersion", "Channel")
ENTRY = "struct<DisplayName:string,DisplayVersion:string,Publisher:string,ProductCode:string,UpgradeCode:string>"
CHILD = f"array<struct<Commands:array<string>,PackageFamilyName:string,AppsAndFeaturesEntries:array<{ENTRY}>>>"


def text_of(json: Column) -> Column:
    """A JSON scalar as plain text; null for lists, maps and nothing."""
    return F.when(~json.substr(1, 1).isin("{", "["), F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"])


def json_of(text: Column) -> Column:
    """Plain text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def strings_of(json: Column) -> Column:
    """A JSON list of strings; nothing or a blank text is the empty list."""
    return F.coalesce(F.from_json(F.nullif(F.trim(json), F.lit("")), "array<string>"), F.array().cast("array<string>"))


def overlay(base: Column, top: Column) -> Column:
    """Map ``top`` over ``base``; either may be null."""
    empty = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(base, empty), F.coalesce(top, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def canonical_json(fields: Column) -> Column:
    """Canonical text of a map of canonical values: keys sorted."""
    items = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(json_of(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def _facts() -> dict[str, Column]:
    """What the rules need to know of a group."""
    get = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    of = lambda t: F.count_if(F.col("frag_type") == t)
    locale = lambda t, k: F.max(F.when(F.col("frag_type") == t, F.lower(text_of(get(k)))))
    return {
        "n": F.count(F.lit(1)), "errors": F.count("error"), **{k: F.count_if(F.col("error").isNull() & get(k).isNull()) for k in COMMON},
        **{f"d_{k}": F.min(get(k)) != F.max(get(k)) for k in COMMON[:3]}, "version": of("version"), "installer": of("installer"), "defaultlocale": of("defaultlocale"),
        "unknown": F.count_if(~F.coalesce(F.col("frag_type"), F.lit("")).isin("version", "installer", "defaultlocale", "locale")), "whole": F.count_if(F.col("frag_type").isin("merged", "singleton")),
        "want": locale("version", "DefaultLocale"), "have": locale("defaultlocale", "PackageLocale"), "installers": F.count(get("Installers")),
    }


def _broken(fact: Callable[[str], Column]) -> Column:
    """The rules that a group breaks, by its facts."""
    many = fact("n") > 1
    rules = [(fact("errors") > 0, "unreadable fragment"), *((fact(k) > 0, f"{k} is missing") for k in COMMON), *((many & fact(f"d_{k}"), f"{k} differs") for k in COMMON[:3])]
    rules += [(many & (fact(t) != 1), f"not exactly one {t} fragment") for t in ("version", "installer", "defaultlocale")]
    rules += [(many & (fact("unknown") > 0), "unknown fragment type"), (~many & (fact("whole") == 0), "a lone fragment must be merged or singleton"), (many & ~fact("want").eqNullSafe(fact("have")), "default locale differs"), (fact("installers") == 0, "Installers is missing")]
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))


def check_groups(fragments: DataFrame) -> DataFrame:
    """version_dir, rule: every broken rule of every group."""
    g = fragments.groupBy("version_dir").agg(*(v.alias(k) for k, v in _facts().items()))
    return g.select("version_dir", F.explode(_broken(F.col)).alias("rule"))


def _merged(column: str) -> dict[str, Column]:
    """What a group needs of one map column: the parts and the ordered texts of the other locales."""
    f = F.col(column)
    one = lambda t: F.max_by(F.when(F.col("frag_type") == t, f), F.when(F.col("frag_type") == t, F.col("file_name")))
    name = F.coalesce(text_of(F.try_element_at(f, F.lit("PackageLocale"))), F.lit(""))
    other = F.when(F.col("frag_type") == "locale", F.struct(F.lower(name).alias("l"), name.alias("name"), F.col("file_name"), canonical_json(_bare(f)).alias("text")))
    return {"single": F.max_by(f, "file_name"), "installer": one("installer"), "locale": one("defaultlocale"), "others": F.array_sort(F.collect_list(other))}


def _bare(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*COMMON))


def _overlaid(part: dict[str, Column]) -> Column:
    localization = F.when(F.size(part["others"]) > 0, F.create_map(F.lit("Localization"), F.concat(F.lit("["), F.array_join(F.transform(part["others"], lambda x: x["text"]), ","), F.lit("]"))))
    merged = overlay(overlay(overlay(part["installer"], _bare(part["locale"])), localization), F.create_map(F.lit("ManifestType"), F.lit('"merged"')))
    return overlay(F.when(F.col("source_file_count") == 1, part["single"]).otherwise(merged), F.create_map(F.lit("PackageVersion"), json_of(nz.last_segment(F.col("version_dir")))))


def assemble_records(fragments: DataFrame) -> DataFrame:
    """One record for each group: version_dir, identity, fields, child_fields, installers, record (canonical text), source_file_count.

    The installer's fields are overlaid by the default locale's, other locales are nested in order of name, and the
    version is the last part of the directory whatever the files say.  One aggregation gathers both maps.
    """
    return _identified(_overlaid_groups(fragments.groupBy("version_dir").agg(*(v.alias(k) for k, v in _gathered().items()))))


def checked_records(fragments: DataFrame) -> DataFrame:
    """What ``assemble_records`` gives, with ``rules``, those that the group breaks: fragments are shuffled once for both."""
    facts = F.struct(*(v.alias(k) for k, v in _facts().items())).alias("facts")
    g = fragments.groupBy("version_dir").agg(*(v.alias(k) for k, v in _gathered().items()), facts)
    return _identified(_overlaid_groups(g, _broken(lambda k: F.col(f"facts.{k}")).alias("rules")), "rules")


def _gathered() -> dict[str, Column]:
    maps = {f"{c}_{k}": v for c in ("fields", "child_fields") for k, v in _merged(c).items()}
    return {"source_file_count": F.count(F.lit(1)), "installers": F.max_by("installers", F.when(F.col("installers").isNotNull(), F.col("file_name")))} | maps


def _overlaid_groups(g: DataFrame, *more: Column) -> DataFrame:
    made = (_overlaid({k: F.col(f"{c}_{k}") for k in ("single", "installer", "locale", "others")}).alias(c) for c in ("fields", "child_fields"))
    return g.select("version_dir", "source_file_count", "installers", *made, *more)


def _identified(rows: DataFrame, *more: str) -> DataFrame:
    """Records from version_dir, source_file_count, installers, fields, child_fields."""
    plain = lambda k: text_of(F.try_element_at(F.col("fields"), F.lit(k)))
    return rows.select(
        "version_dir", plain("PackageIdentifier").alias("package_id"), nz.last_segment(F.col("version_dir")).alias("package_version"), F.coalesce(plain("Channel"), F.lit("")).alias("channel"),
        "fields", "child_fields", "installers", canonical_json(F.col("fields")).alias("record"), "source_file_count", *more,
    )


def render_records(records: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """version_dir, package_id, record: the canonical text of all or of the targets' records."""
    rows = records if targets is None else records.join(targets.select("version_dir"), "version_dir", "left_semi")
    return rows.select("version_dir", "package_id", "record")


def _without(entries, lost: set[str]):
    """A list of installed-program entries without the lost display versions."""
    for e in entries if isinstance(entries, list) else ():
        v = e.get("DisplayVersion") if isinstance(e, dict) else None
        if v is not None and not isinstance(v, (dict, list)) and (str(v).lower() if isinstance(v, bool) else str(v)) in lost:
            del e["DisplayVersion"]


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def tidy(fields: dict, lost: set[str]) -> dict:
        out = dict(fields)
        for key in ("AppsAndFeaturesEntries", "Installers"):
            if key in out:
                tree = json.loads(out[key])
                for x in [tree] if key != "Installers" else [i.get("AppsAndFeaturesEntries") for i in tree if isinstance(i, dict)]:
                    _without(x, lost)
                tree = canonical(tree, key)
                out[key] = dump(tree)
                if tree in ([], {}):
                    del out[key]
        return out

    for frame in batches:
        lost = [{*x} for x in frame["_lost"]]
        for c in ("fields", "child_fields"):
            frame[c] = [tidy(f, x) for f, x in zip(frame[c], lost, strict=True)]
        frame["installers"] = [None if m is None else [tidy(dict(i), x) for i in m] for m, x in zip(frame["installers"], lost, strict=True)]
        yield frame.drop(columns="_lost")


def strip_display_versions(records: DataFrame, lost: DataFrame) -> DataFrame:
    """Records of which those in ``lost`` (version_dir, value) have given up these display versions, at the root and in
    their installers; entries that are left empty go.  Only these records pass through Python."""
    gone = lost.groupBy("version_dir").agg(F.collect_set("value").alias("_lost"))
    base = ["version_dir", "source_file_count", "installers", "fields", "child_fields"]
    kinds = dict(records.dtypes)
    hit = records.join(gone, "version_dir").select(*base, "_lost").mapInPandas(_strip, ", ".join(f"{c} {kinds[c]}" for c in base))
    return records.join(gone, "version_dir", "left_anti").unionByName(_identified(hit))


def child_records(records: DataFrame) -> DataFrame:
    """version_dir, child_sha, url, architecture, type, locale, scope, family, product_codes: each record's distinct installers.

    An installer counts with the record's fields under it, but for descriptive ones; commands, protocols and file
    extensions never change its identity.
    """
    root = F.map_filter("child_fields", lambda k, _: ~k.isin(*DESCRIPTIVE, *IDENTITY, "Installers"))
    raw = records.select("version_dir", F.map_filter("child_fields", lambda k, _: k.isin(*IDENTITY)).alias("id"), root.alias("root"), F.explode("installers").alias("own"))
    made = raw.withColumn("installer", overlay(F.col("root"), F.col("own")))
    text = canonical_json(overlay(F.col("id"), F.create_map(F.lit("Installer"), canonical_json(F.col("installer")))))
    field = lambda k: text_of(F.try_element_at(F.col("installer"), F.lit(k)))
    entries = F.from_json(F.try_element_at(F.col("installer"), F.lit("AppsAndFeaturesEntries")), f"array<{ENTRY}>")
    codes = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(entries, F.array()), lambda e: e["ProductCode"]))))
    return made.select(
        "version_dir", F.sha2(text, 256).alias("child_sha"), field("InstallerUrl").alias("url"), field("Architecture").alias("architecture"), field("InstallerType").alias("type"),
        F.coalesce(field("InstallerLocale"), field("PackageLocale")).alias("locale"), field("Scope").alias("scope"), field("PackageFamilyName").alias("family"), codes.alias("product_codes"),
    ).distinct()


def children_hash(children: DataFrame, owner: str = "version_dir", child: str = "child_sha") -> DataFrame:
    """owner, children_sha: one hash over the sorted distinct children of each owner."""
    listed = diff.gathered(children, owner, child, "_children")
    return listed.select(owner, F.sha2(F.array_join(F.array_sort(F.transform("_children", diff.unpacked)), ""), 256).alias("children_sha"))


def _with_entries(records: DataFrame) -> DataFrame:
    """Records with ``_kids``, their installers, and ``_entries``, the installed programs named at the root and in them."""
    get = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    rows = records.withColumn("_kids", F.coalesce(F.from_json(get("Installers"), CHILD), F.array().cast(CHILD)))
    return rows.withColumn("_entries", F.concat(F.coalesce(F.from_json(get("AppsAndFeaturesEntries"), f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>")), F.flatten(F.transform("_kids", lambda c: F.coalesce(c["AppsAndFeaturesEntries"], F.array().cast(f"array<{ENTRY}>"))))))


def _tidy(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def claimed_versions(records: DataFrame) -> DataFrame:
    """The records with claimed_versions: what ``project_index`` gives as display_versions."""
    return _with_entries(records).withColumn("claimed_versions", _tidy(F.transform("_entries", lambda e: e["DisplayVersion"]))).drop("_kids", "_entries")


def project_index(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """version_dir, name, publisher, moniker and the sorted sets of tags, commands, families, codes, names and publishers."""
    get = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    none = F.array().cast("array<string>")
    strings = lambda k: strings_of(get(k))
    locales = F.coalesce(F.from_json(get("Localization"), "array<struct<PackageName:string,Publisher:string>>"), F.array())
    rows, tidy = _with_entries(records), _tidy
    pick = lambda f: F.transform("_entries", lambda e: e[f])
    listed = rows.select(
        "version_dir", text_of(get("PackageName")).alias("package_name"), text_of(get("Publisher")).alias("publisher"), text_of(get("Moniker")).alias("moniker"),
        tidy(strings("Tags")).alias("tags"), tidy(strings("Commands"), F.flatten(F.transform("_kids", lambda c: F.coalesce(c["Commands"], none)))).alias("commands"),
        tidy(F.array(text_of(get("PackageFamilyName"))), F.transform("_kids", lambda c: c["PackageFamilyName"])).alias("families"), tidy(pick("ProductCode")).alias("product_codes"), tidy(pick("UpgradeCode")).alias("upgrade_codes"),
        tidy(pick("DisplayVersion")).alias("display_versions"), F.array_compact(F.concat(F.array(text_of(get("PackageName"))), F.transform(locales, lambda x: x["PackageName"]))).alias("_names"),
        F.array_compact(pick("DisplayName")).alias("_displays"), F.array_compact(F.concat(F.array(text_of(get("Publisher"))), F.transform(locales, lambda x: x["Publisher"]), pick("Publisher"))).alias("_publishers"),
    )

    def tagged(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("k"), x.alias("t")))

    # names are normalised as rows of a table of their own, so that each is brought to NFKC once
    said = listed.select("version_dir", F.explode(F.concat(tagged("_names", "n"), tagged("_displays", "d"), tagged("_publishers", "p"))).alias("s")).select("version_dir", "s.k", nz.nfkc(F.col("s.t"), ascii_only).alias("t"))
    keys = F.when(F.col("k") == "d", nz.name_variants(F.col("t"), True, True)).when(F.col("k") == "n", nz.name_variants(F.col("t"), False, True)).otherwise(F.array(F.nullif(nz.normalize_publisher(F.col("t"), True), F.lit(""))))
    sets = said.select("version_dir", F.when(F.col("k") == "p", "p").otherwise("n").alias("k"), F.explode(keys).alias("v")).where("v IS NOT NULL").groupBy("version_dir").agg(
        F.array_sort(F.collect_set(F.when(F.col("k") == "n", F.col("v")))).alias("norm_names"), F.array_sort(F.collect_set(F.when(F.col("k") == "p", F.col("v")))).alias("norm_publishers")
    )
    return listed.drop("_names", "_displays", "_publishers").join(sets, "version_dir", "left").withColumns({c: F.coalesce(c, none) for c in ("norm_names", "norm_publishers")})


def fragment_warnings(fragments: DataFrame) -> DataFrame:
    """warning, files."""
    return fragments.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("files"))
