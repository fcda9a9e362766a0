import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_text_operators(tmp_path):
    """The catalog engine imports and lists its queries where the text operators are absent."""
    for p in ("__spark_entry__.py", "coursewright"):
        src = ROOT / p
        subprocess.run(["cp", "-r", str(src), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "coursewright" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"month", "total"}
