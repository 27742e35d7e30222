"""The registry still imports without the llm folders and the pipeline."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_without_llm(tmp_path):
    for name in ("catalogspark", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j3_diff_records' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for path in (ROOT / "catalogspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "catalogspark.llm" not in path.read_text()
