"""The entry module can be read without a session, and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"


def count(cwd):
    return int(subprocess.run([sys.executable, "-B", "-c", SAY], cwd=cwd, capture_output=True, text=True, check=True).stdout.split()[-1])


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "medialake", tmp_path / "medialake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert count(tmp_path) <= count(ROOT)
    assert count(tmp_path) > 100


def test_views_have_one_meaning():
    import re
    from collections import Counter
    from pathlib import Path

    named = Counter(name for f in (Path(__file__).resolve().parents[1] / "medialake").rglob("*.py") for name in re.findall(r'(?m)^(?:SQL\["(v_\w+)"\] =|    "(v_\w+)":)', f.read_text()))
    assert named and max(named.values()) == 1
