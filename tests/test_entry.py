"""The driver contract holds, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "tickloom"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tickloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100; assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
