"""Normal forms and search keys of names in any script, held against Python's own tables."""

import random
import sys
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogspark.functions import normalize as nz
from catalogspark.operators import records


@pytest.fixture(scope="module")
def texts():
    """Every assigned code point, and random strings of those that decompose, combine or compose."""
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    pool = [c for c in points if unicodedata.decomposition(c) or unicodedata.combining(c) or "ᄀ" <= c < "ሀ" or "가" <= c < "뀀"]
    rng = random.Random(5)
    return points + ["".join(rng.choices(pool, k=rng.randint(2, 9))) for _ in range(50_000)] + ["", "plain", None]


def test_nfkc_equals_the_unicode_tables(spark, texts):
    rows = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": texts}), "i long, t string")
    made = rows.select("i", nz.nfkc(F.col("t")).alias("n")).toPandas().sort_values("i")["n"].tolist()
    wrong = [(t, m) for t, m in zip(texts, made, strict=True) if m != (None if t is None else unicodedata.normalize("NFKC", t))]
    assert wrong == []


def test_no_name_leaves_the_jvm(spark):
    names = spark.createDataFrame([("a", "b")], "t string, u string")
    fragments = spark.createDataFrame([], "version_dir string, fields map<string,string>")
    for df in (
        names.select(nz.normalize_name(F.col("t")), nz.name_variants(F.col("t"), True), nz.normalize_publisher(F.col("u"))),
        records.project_index(fragments),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "reflect(com.ibm.icu" in plan


@pytest.mark.parametrize(
    ("name", "base", "architecture"),
    [
        ("Ｆｏｏ　Ｂａｒ (ｘ６４)", "foobar", "X64"),  # full-width letters, digits and blank
        ("ﬁle № ５", "fileno5", None),
        ("Édition 32-bit", "édition", "X86"),  # letter and accent become one letter
        ("ガイド", "ガイド", None),
        ("한글", "한글", None),
        ("工具 zh-CN", "工具", None),
        ("", "", None),
        (None, None, None),
    ],
)
def test_names_in_any_script(spark, name, base, architecture):
    row = spark.createDataFrame([(name,)], "t string").select(nz.normalize_name(F.col("t")).alias("n"), nz.normalize_publisher(F.col("t")).alias("p")).first()
    assert (row.n.base, row.n.architecture) == (base, architecture)


def test_publishers_in_any_script(spark):
    rows = spark.createDataFrame([("Ｇｒöße ＧｍｂＨ Berlin",), ("株式会社 ＡＢＣ Ｃｏ. Ltd",), ("GmbH",), (None,)], "t string")
    assert [r[0] for r in rows.select(nz.normalize_publisher(F.col("t"))).collect()] == ["größe", "株式会社abc", "gmbh", None]
