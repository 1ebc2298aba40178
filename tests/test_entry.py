import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_parts(tmp_path):
    for p in REPO.iterdir():
        if p.name in ("siftwell", "__spark_entry__.py"):
            (tmp_path / p.name).symlink_to(p) if p.is_file() else None
    (tmp_path / "siftwell").mkdir()
    for p in (REPO / "siftwell").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "siftwell" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert 'delete_plan' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
