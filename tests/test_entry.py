"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names_in(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    queries, sql = out.stdout.split("\n")[:2]
    return set(queries.split()), set(sql.split())


def test_imports_without_a_session_and_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "folioq"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "folioq" / "llm", ignore_errors=True)
    queries, sql = names_in(tmp_path)
    assert "dense_topk" in queries and sql <= queries
    assert not any(q.startswith("op") for q in queries) and "pipeline" not in queries


def test_sql_only_for_known_queries():
    queries, sql = names_in(ROOT)
    assert sql <= queries


def test_entry(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "vec_id", "score", "snippet"] and df.count() > 0
