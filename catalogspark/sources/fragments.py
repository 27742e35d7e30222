"""YAML fragments as rows: one pass in Python that leaves canonical JSON text, everything after is native."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# List fields whose order carries no meaning; keys that never count for a child's identity.
SET_FIELDS = frozenset((
    "Tags", "Capabilities", "RestrictedCapabilities", "Platform", "InstallModes", "UnsupportedArguments", "UnsupportedOSArchitectures", "Commands", "Protocols", "FileExtensions",
    "AllowedMarkets", "ExcludedMarkets", "PackageDependencies", "WindowsFeatures", "ExternalDependencies",
))
NOT_IDENTITY = frozenset(("Commands", "Protocols", "FileExtensions"))

#: Under this key the loader gives the node of the version back: one parse is enough.
VERSION_NODE = "\0version"

SCHEMA = "version_dir string, path string, file_name string, frag_type string, fields map<string,string>, child_fields map<string,string>, installers array<map<string,string>>, warnings array<string>, error string"
HASHED = f"{SCHEMA}, raw_sha256 string"


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def canonical(value, key: str = "", dropped: frozenset = frozenset()):
    """Nulls, empty lists and empty maps left out, children first; set-like lists sorted by their text."""
    if isinstance(value, dict):
        for k in value:
            if not isinstance(k, str):
                raise ValueError("keys must be strings")
        made = {k: canonical(v, k, dropped) for k, v in value.items() if k not in dropped}
        return {k: v for k, v in made.items() if v is not None and v != [] and v != {}}
    if isinstance(value, list):
        made = [x for x in (canonical(v, key, dropped) for v in value) if x is not None and x != [] and x != {}]
        if key == "Localization":
            made.sort(key=lambda x: str(x.get("PackageLocale", "")).lower() if isinstance(x, dict) else "")
        elif key in SET_FIELDS:
            made.sort(key=dump)
        return made
    return value


#: Texts that both of yaml's parsers read alike: the C one, which takes a tenth of the time, is given no others.
PLAIN = re.compile(rb"[A-Za-z_][\n \"#$'-),-9:;<=@-{}~]*")


def loader(parser: str = "SafeLoader"):
    """YAML 1.2 core scalars only (no dates, sexagesimals, yes/no), and a repeated key is an error."""
    import yaml

    class Loader(getattr(yaml, parser)):
        yaml_implicit_resolvers: dict = {}
        top = None

        def construct_mapping(self, node, deep=False):
            keys = [k.value for k, _ in node.value]
            if len(keys) != len({*keys}):
                raise ValueError("a key is repeated")
            made = super().construct_mapping(node, deep)
            if self.top is node:  # the version's own text, whatever type it looks like
                version = next((v for k, v in node.value if k.value == "PackageVersion"), None)
                if version is not None:
                    made[VERSION_NODE] = version
            return made

        def construct_document(self, node):
            self.top = node
            return super().construct_document(node)

    for tag, pattern, first in (
        ("null", r"(?:~|null|Null|NULL|)", ["~", "n", "N", ""]),
        ("bool", r"(?:true|True|TRUE|false|False|FALSE)", list("tTfF")),
        ("int", r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)", list("-+0123456789")),
        ("float", r"(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))", list("-+.0123456789")),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^{pattern}$"), first)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if node.value.lstrip("+-")[:2] in ("0x", "0o") else int(node.value))
    Loader.add_constructor("tag:yaml.org,2002:float", lambda self, node: float(node.value.replace(".inf", "inf").replace(".Inf", "inf").replace(".INF", "inf").replace(".nan", "nan").replace(".NaN", "nan").replace(".NAN", "nan")))
    return Loader


def fast_loader():
    """The loader with yaml's C parser; None where yaml lacks it."""
    import yaml

    return loader("CSafeLoader") if yaml.__with_libyaml__ else None


def tree_of(content: bytes, load, fast=None):
    """What a text holds.  ``fast`` reads plain ones; where it finds a fault, the other one says what it is."""
    import yaml

    if fast is not None and PLAIN.fullmatch(content):
        try:
            return yaml.load(content.decode("ascii"), Loader=fast)
        except Exception:  # told below
            pass
    return yaml.load(content.decode("utf-8"), Loader=load)


def parse(path: str, content: bytes, load, fast=None) -> dict:
    """One fragment; a text that can't be read gives its error instead of fields."""
    folder, _, name = path.rpartition("/")
    row = {"version_dir": folder, "path": path, "file_name": name, "frag_type": None, "fields": None, "child_fields": None, "installers": None, "warnings": [], "error": None}
    try:
        tree = tree_of(content, load, fast)
        if not isinstance(tree, dict):
            raise ValueError("not a mapping")
        version = tree.pop(VERSION_NODE, None)
        if version is not None and version.value != "":
            if isinstance(tree["PackageVersion"], (int, float)) and not isinstance(tree["PackageVersion"], bool):
                row["warnings"] = [f"PackageVersion {version.value} is a number"]
            tree["PackageVersion"] = version.value
        kind = tree.get("ManifestType")
        row["frag_type"] = None if kind is None else str(kind).lower()
        row["fields"] = [(k, dump(v)) for k, v in canonical(tree).items()]
        own = canonical(tree, "", NOT_IDENTITY)
        row["child_fields"] = [(k, dump(v)) for k, v in own.items()]
        if isinstance(own.get("Installers"), list):  # each value as JSON text, so that 1 and "1" stay apart
            row["installers"] = [[(k, dump(v)) for k, v in x.items()] for x in own["Installers"] if isinstance(x, dict)]
    except Exception as e:  # the file's own fault; reported as a violation by the record checks
        row["error"] = f"{type(e).__name__}: {e}"[:500]
    return row


def parse_fragments(contents: DataFrame, hashes: bool = False) -> DataFrame:
    """(path, content) to fragments; with ``hashes`` also raw_sha256 of the bytes, so that a file is opened once for both."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, fast = loader(), fast_loader()
        for frame in frames:
            rows = [parse(p, bytes(c), load, fast) for p, c in zip(frame["path"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["version_dir", "path", "file_name", "frag_type", "fields", "child_fields", "installers", "warnings", "error"])
            for c in ("fields", "child_fields"):
                out[c] = [None if x is None else dict(x) for x in out[c]]
            out["installers"] = [None if x is None else [dict(m) for m in x] for x in out["installers"]]
            if hashes:
                out["raw_sha256"] = [hashlib.sha256(bytes(c)).hexdigest() for c in frame["content"]]
            yield out

    return contents.select("path", "content").mapInPandas(run, HASHED if hashes else SCHEMA)
