"""Every registered grid and vector query against its SQL on the smallest scale."""

import pytest

from gridloom.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, data, duck, same):
    same(registry.queries()[name](spark, data), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_without_sql(name, spark, data):
    df = registry.queries()[name](spark, data)
    rows = df.collect()
    assert rows
    for c, kind in df.dtypes:
        if kind == "double":
            assert all(r[c] is None or r[c] == r[c] for r in rows)


def test_flagship(spark, data):
    (row,) = registry.flagship(spark, data).collect()
    assert row["num_patches"] == 36
    assert abs(row["total_ha"] - 2.03) < 1e-9
    assert abs(row["division"] + row["mesh_ha"] / row["total_ha"] - 1) < 1e-9


def test_entry_imports_without_the_corpus_part(tmp_path):
    """The entry module works where the corpus folders have been deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'hysteresis' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
