import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "almanac"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else subprocess.run(["cp", "-r", REPO / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "almanac/llm"], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1') for n in q) and len(q) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for f in (REPO / "almanac").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "almanac.llm" not in f.read_text(), f
