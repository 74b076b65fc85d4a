from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

from plumbline.plans.catalogue import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_imports_without_the_optional_parts(tmp_path):
    (tmp_path / "plumbline").mkdir()
    for p in ROOT.joinpath("plumbline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "plumbline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'describe' in q and not any(x.startswith('op1') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
