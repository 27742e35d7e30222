"""Search keys of names and publishers, path parts and content-addressed paths: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-entity suffixes cut off publishers, architecture tokens in the order they are taken out.
LEGAL_SUFFIXES = (
    "ab", "ad", "ag", "aps", "as", "asa", "bv", "co", "company", "corp", "corporation", "cv", "doo", "ev", "ges", "gesmbh", "gmbh", "holding", "holdings", "inc", "incorporated",
    "kg", "ks", "limited", "llc", "lp", "ltd", "ltda", "mbh", "nv", "plc", "ps", "pty", "pvt", "sa", "sarl", "sca", "sc", "sl", "spa", "sp", "srl", "sro", "subsidiary",
)
ARCH_TOKENS = ("x86_64", "x64", "x86", "64-bit", "64 bit", "32-bit", "32 bit")
X86_TOKENS = ("x86", "32 bit", "32-bit")
X64_TOKENS = ("x64", "x86_64", "64 bit", "64-bit")

NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


NON_ASCII = r"[^\x00-\x7F]"


def nfkc(text: Column, ascii_only: bool = False) -> Column:
    """NFKC by ICU, which every Spark 4 carries for its collations: called through ``reflect``, so no row leaves the JVM.

    Only text beyond ASCII is passed to it, as ASCII is its own normal form; null stays null.  ``ascii_only`` promises
    ASCII input and spares the test.
    """
    if ascii_only:
        return text
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))  # True: by compatibility
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def architecture(text: Column) -> Column:
    """X86 or X64 if tokens of exactly one family are in the lower-case text."""
    has = lambda tokens: F.greatest(*(F.contains(text, F.lit(t)) for t in tokens))
    return F.when(has(X86_TOKENS) & ~has(X64_TOKENS), "X86").when(has(X64_TOKENS) & ~has(X86_TOKENS), "X64")


def normalize_name(text: Column, ascii_only: bool = False) -> Column:
    """struct(base, architecture): lower case, without architecture and ll-RR locale tokens, letters and digits only."""
    low = F.lower(nfkc(text, ascii_only))
    bare = low
    for token in ARCH_TOKENS:
        bare = F.replace(bare, F.lit(token), F.lit(" "))
    words = F.filter(F.split(bare, r"(?U)[\s()\[\]]"), lambda w: ~w.rlike("^[a-z]{2}-[a-z]{2}$") & (w != ""))
    return F.struct(F.regexp_replace(F.array_join(words, " "), NOT_ALNUM, "").alias("base"), architecture(low).alias("architecture"))


def name_variants(text: Column, with_architecture: bool, ascii_only: bool = False) -> Column:
    """Search keys of a name: its base if not empty, and base(ARCH) for display names."""
    n = normalize_name(text, ascii_only)
    base = F.when(n["base"] != "", n["base"])
    arch = F.when(n["architecture"].isNotNull(), F.concat(n["base"], F.lit("("), n["architecture"], F.lit(")")))
    return F.array_compact(F.array(base, arch) if with_architecture else F.array(base))


def normalize_publisher(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case letters and digits up to the first legal suffix that is not the first word."""
    words = F.filter(F.split(F.lower(nfkc(text, ascii_only)), NOT_ALNUM), lambda w: w != "")
    cut = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*LEGAL_SUFFIXES), i)), lambda i: i.isNotNull())
    return F.array_join(F.slice(words, F.lit(1), F.coalesce(F.get(cut, 0), F.size(words))), "")


def sanitize(segment: Column) -> Column:
    return F.regexp_replace(segment, "[^A-Za-z0-9._-]", "_")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def record_relpath(package_id: Column, version: Column, sha: Column) -> Column:
    """manifests/<first letter>/<id parts>/<version>/<8 hex>-<id>.yaml"""
    first = F.lower(F.substring(F.coalesce(F.nullif(package_id, F.lit("")), F.lit("x")), 1, 1))
    parts = F.array_join(F.transform(F.split(package_id, r"\."), sanitize), "/")
    return F.concat(F.lit("manifests/"), first, F.lit("/"), parts, F.lit("/"), sanitize(version), F.lit("/"), F.substring(sha, 1, 8), F.lit("-"), sanitize(package_id), F.lit(".yaml"))


def sidecar_relpath(package_id: Column, sha: Column) -> Column:
    return F.concat_ws("/", F.lit("packages"), sanitize(package_id), F.lower(F.substring(sha, 1, 8)), F.lit("versionData.json"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the path itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
