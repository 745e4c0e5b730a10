import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry points import and keep the other queries."""
    for name in ("quire", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quire/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_filter' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.glob("quire/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quire.llm" not in p.read_text()


def test_missing_module_of_others_leaves_the_core_queries(tmp_path):
    """The corpus operators need modules that the rest does not; without one of them the rest still stands."""
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\", name='xxhash')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_filter' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    path = f"{tmp_path}:{ROOT}"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": path})
