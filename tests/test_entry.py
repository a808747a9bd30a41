"""The driver's contract, with and without the optional parts."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.restored_ok for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "chunkvault", tmp_path / "chunkvault", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_entry.py"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests", "-k", "prefix or xor or wire or judge_manifest or stream_dedup"], cwd=tmp_path, check=True, timeout=300)
